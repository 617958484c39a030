"""Wrappers and vector links against brute force, and their defined cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import components, vectors, wrappers


def page(title, paragraphs, links=3):
    nav = "".join(f'<li><a href="/{i}">menu {i} {title}</a></li>' for i in range(links))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav>'
        f'<!-- c --><div class="ad">Buy {title}</div><article><h1>{title}</h1>{body}</article><div id="comments"><p>first! {title}</p></div><footer>&copy; x</footer></body></html>'
    )


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://h{i % 2}.example.org/p{i}", page(f"T{i}", [f"One &amp; <b>two</b>\n three {i}.", *(f"More {j}" for j in range(i % 4))], 2 + i % 3)) for i in range(12)]
    rows += [(50, None, None), (51, "odd", ""), (52, "https://h0.example.org/cut", page("Cut", ["kept text"])[:-80]), (53, "https://plain.example.org", "<div>Only <i>text</i><br>here</div><div class='menu'>x</div>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(3)


def test_extract(pages, spark):
    found = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    for i in range(12):
        assert found[i]["text"] == "\n".join([f"T{i}", f"One & two three {i}.", *(f"More {j}" for j in range(i % 4))])
        assert found[i]["n_chars"] == len(found[i]["text"])
    assert found[50]["text"] == found[51]["text"] == "" and found[52]["text"] == "Cut\nkept text"
    assert found[53]["text"] == "Only text here"
    assert wrappers.extract(spark.createDataFrame([], pages.schema)).count() == 0


def test_join_instead_of_broadcast(pages, monkeypatch):
    want = sorted(map(tuple, wrappers.extract(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, wrappers.extract(pages).collect()), key=str) == sorted(want, key=str)


def test_wrapper_has_repeats_options_and_slots(pages):
    found = {r["host"]: r["expression"] for r in wrappers.wrapper_expressions(pages).collect()}
    assert "(<li><a>#</a></li>)+" in found["h0.example.org"] and "<article><h1>#</h1>" in found["h0.example.org"]
    a, b = (wrappers._unplaced(wrappers.read(x)[0]) for x in ("<p></p><p>one</p>", "<p>two</p><div></div>"))
    assert wrappers.expression(wrappers.align(a, b)) == "(<p></p>)?<p>#</p>(<div></div>)?"
    c = wrappers._unplaced(wrappers.read("<p>a</p><p>b</p><p>c</p><div></div>")[0])
    assert wrappers.expression(wrappers.align(wrappers.align(a, b), c)) == "(<p>(#)?</p>)+(<div></div>)?"


def plain_page(i):
    """No tag or class tells what is what; menus are words or links, one in three pages has a notice."""
    menu = "".join(f"<div>{x}</div>" for x in ("Front", "World", "Sports"))
    links = "".join(f"<div><a href='/{i}/{j}'>story {i} {j}</a></div>" for j in range(2 + i % 3))
    body = "".join(f"<p>Sentence {j} of {i}.</p>" for j in range(1 + i % 4))
    notice = "<div><p>We moved house.</p><p>Write to us.</p></div>" if i % 3 else ""
    text = "\n".join([f"Title {i}", *(f"Sentence {j} of {i}." for j in range(1 + i % 4))])
    return f"<html><body><div>{menu}</div><div>{links}</div>{notice}<div><h1>Title {i}</h1>{body}</div><div>All rights, some wrongs</div></body></html>", text


def test_wrapper_alone_drops_unmarked_menus(spark):
    made = [plain_page(i) for i in range(12)]
    rows = [(i, "http://bare.example.org/x", html) for i, (html, _) in enumerate(made)]
    rows += [(100 + i, "http://same.example.org/x", "<body><div>Menu</div><p>Every page is this one.</p></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert [found[i] for i in range(12)] == [text for _, text in made]
    assert {found[100 + i] for i in range(5)} == {"Menu\nEvery page is this one."}


def test_extraction_needs_the_alignment(monkeypatch):
    def texts():
        whole = wrappers.Wrapper()
        read = [wrappers.read(plain_page(i)[0]) for i in range(12)]
        for x in read:
            whole.add(x[0])
        whole = wrappers.Wrapper.load(whole.dump())
        return ["\n".join(blocks[j] for j in whole.main_blocks(tree)) for tree, blocks, _ in read]

    assert texts() == [plain_page(i)[1] for i in range(12)]
    monkeypatch.setattr(wrappers, "align", lambda a, b: [])
    assert texts() == [""] * 12


def test_copies_count_once_in_any_layout(spark):
    """Copies over many tasks are one page: the text does not depend on how rows are dealt."""
    copy, other = ("<body><div>Menu</div><p>Alpha story text</p></body>", "<body><div>Menu</div><p>Beta other words</p></body>")
    rows = [(i, "http://few.org/x", copy if i < 4 else other) for i in range(5)]
    rows += [(10 + i, "http://bare.org/x", plain_page(i // 3)[0]) for i in range(36)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r["page_id"]: r["text"] for r in wrappers.extract(df.repartition(n)).collect()} for n in (1, 8)]
    assert found[0] == found[1] and found[0][0] == "Menu\nAlpha story text" and found[0][4] == "Menu\nBeta other words"
    assert [found[0][10 + i] for i in range(36)] == [plain_page(i // 3)[1] for i in range(36)]


def test_alignment_is_the_heaviest(monkeypatch):
    """Against all alignments of short lists; tables that are split weigh the same, and long lists take seconds."""
    rng = random.Random(8)
    item = lambda: rng.choice([("#", 1, 1, 1, ()), ("p.a", []), ("p.b", []), ("div.nav", []), ("div.x", [("p", [])]), ("ul", [("li", [])]), ("+", [("p.a", [])])])

    def weight(x, y):
        w = wrappers._Weights([x], [y])
        return int(w.row(0, 0, 1)[0])

    assert [weight(("p.a", []), y) for y in (("p.a", []), ("p.b", []), ("+", [("p.a", [])]), ("div", []), ("p.a", [("b", [])]), ("p.nav", []))] == [4, 1, 4, 0, 2, 0]

    def most(a, b):
        return max(most(a[1:], b), most(a, b[1:]), most(a[1:], b[1:]) + weight(a[0], b[0])) if a and b else 0

    for _ in range(40):
        a, b = ([item() for _ in range(rng.randint(0, 6))] for _ in range(2))
        for cells in (1 << 22, 6):
            monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
            pairs = list(wrappers._pairs(wrappers._Weights(a, b), 0, len(a), 0, len(b)))
            assert pairs == sorted(pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
            assert sum(weight(a[x], b[y]) for x, y in pairs) == most(a, b)
    monkeypatch.setattr(wrappers, "TABLE_CELLS", 1 << 22)
    pages = ["<body>" + "".join(f"<{tag} class={rng.choice('abcdef')}>{i}</{tag}>" for i in range(10_000) for tag in [rng.choice(["p", "div", "h2", "section"])]) for _ in range(2)]
    began = time.time()
    wrappers.align(*(wrappers._unplaced(wrappers.read(x)[0]) for x in pages))
    assert time.time() - began < 10


def test_long_page_and_odd_markup(spark):
    body = "".join(f"<p>Part {i} <b>bold &lt;tag&gt;</b></p>" for i in range(20_000))
    rows = [(1, "http://x.org", f"<main>{body}"), (2, "http://x.org", "<main><p>un<i>closed</p></div></span><p>next<table><tr><td>cell</table>"), (2, None, "<<<>>> & text"), (None, "http://x.org", "<main><p>x")]
    rows += [(3 + i, "http://deep.org", f"<nav>menu</nav>{'<div>' * 5_000}deep {i}{'</div>' * 4_000}<p>more</p>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("w"), "share": F.lit(2)})
    found = {(r["page_id"], r["url"]): r["text"] for r in wrappers.extract(df).collect()}
    assert found[1, "http://x.org"].count("\n") == 19_999 and found[2, "http://x.org"] == "unclosed\nnext\ncell" and found[None, "http://x.org"] == "x" and "text" in found[2, None]
    assert [found[3 + i, "http://deep.org"] for i in range(2)] == [f"deep {i}\nmore" for i in range(2)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.12 * (i % 3)).tolist(), int(i % 2)) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] + [1.0] * 15, 0), (205, rows[0][1], None), (206, [None] + [1.0] * 15, 0), (207, [1.0, 2.0], 0), (208, [], 1), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")), rows


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_vectors(points, tile):
    df, rows = points
    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    root, links = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    found = {r["vec_id"]: r for r in vectors.near_vectors(df, tile=tile).collect()}
    assert len(found) == len(rows) and sum(links.values()) > 100
    for i, r in found.items():
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], find(i), find(i) == i)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    df = spark.createDataFrame(pairs, "a long, b long")
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = {r["id"]: r["component"] for r in components.components(df).collect()}
    assert all(found[x] == find(x) for x in found) and all(x in found for x in root if find(x) != x)
    assert components.components(df.limit(0)).count() == 0

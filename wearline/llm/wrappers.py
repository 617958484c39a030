"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a balanced stream of tags and blocks of text; a block that is mostly links stands
in an ``a`` of its own.  The streams of a host's pages are aligned one after another.  Elements of
the same kind (label and kinds of children) are matched; where the streams differ, repeats are
folded into repeated groups, the longest heaviest alignment is taken, and what only one side has
becomes an optional group, or one more repeat if its neighbour is of its kind.  A text that all
pages share stays a constant, texts that differ become a text slot.  The result is the host's
wrapper.

Wrappers are inferred in three steps (per task and host, per host and share of the tasks, per
host), so no task holds more than one wrapper per other task, whatever share of pages a host has.
They go to the pages by broadcast if their measured size allows it, else by a join.

Then each page is aligned with its host's wrapper, and its text is what lands in main slots of it.
A slot is main if it is no constant of the host (the same text three times or more and on half of
the distinct pages; pages of a host without any varying slot have no such constants), if it is not
a slot of links, if no element around it says otherwise (``OUTSIDE`` tags, ``OUTSIDE_WORDS`` in
class, id or role), and, when the wrapper has an article or main element with text, if it is inside
one; constants there stay.  Text outside of every slot is none.

Defined cases: null and empty pages give the empty text; a null or odd URL counts as one host; a
page cut off in the middle is closed at its end; unknown, unclosed and wrongly nested tags are
taken as browsers mostly do; elements nested deeper than ``DEPTH`` are read as neighbours; equal pages count once for the wrapper and give a row each; only the
three named columns are read, so others may have any names; an empty table gives an empty result;
pages are read whole.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.session import cut

# Fixed values of HTML: elements without content, with raw content, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
OUTSIDE = frozenset("head title nav header footer aside form script style noscript template menu dialog button select option iframe object svg".split())
# Words in class, id or role of what is not main text.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer foot sidebar aside widget comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay subscribe newsletter signup login share sharing social related recommended recommendations "
    "pagination pager toolbar skip copyright legal disclaimer search toc tags".split()
)
MAIN = frozenset(("article", "main"))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-zA-Z][a-z]+|[A-Z]{2,}|[a-zA-Z]+")
#: Open elements, from which on further ones stand beside each other, as browsers have it too.
DEPTH = 100
#: Wrappers of more bytes in total are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _label(tag: str, attributes: str) -> str:
    """A tag with its class, id and role words without digits."""
    if not attributes or "=" not in attributes:
        return tag
    words = sorted({w.lower() for m in ATTRIBUTE.finditer(attributes) for w in NAME.findall(m[2] or m[3] or m[4] or "")})
    return ".".join([tag, *words]) if words else tag


def _outside(label: str) -> bool:
    """Whether an element's tag, or the words of its class, id and role, say that it is outside of main text."""
    tag, *words = label.split(".")
    return tag in OUTSIDE or not OUTSIDE_WORDS.isdisjoint(words) and tag not in ("html", "body", "article", "main")


def read(page: str) -> tuple[list, list[str], str]:
    """The page's tree, its blocks of text and its shape (the tree without texts).

    Items are (label, children) and texts ("#", hash, how many, characters, numbers of the blocks).
    Inline elements are no items, but a block that is mostly links stands in an item "a".
    """
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    blocks: list[str] = []
    shape: list[str] = []
    parts: list[str] = []
    linked = in_link = 0
    home: list = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                leaf = ("#", crc32(text.encode()) + (len(text) << 32), 1, len(text), (len(blocks),))
                blocks.append(text)
                mostly = 2 * linked >= len(text)
                home.append(("a", [leaf]) if mostly else leaf)
                shape.append("a#" if mostly else "#")
        parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag == "a":
                in_link -= 1
            elif tag not in INLINE:
                flush()
                shape.append(")")
            stack.pop()

    def put(text: str) -> None:
        nonlocal linked, home
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if not parts or not "".join(parts).strip():
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            home = stack[k][1]
        parts.append(text)
        if in_link and text.strip():
            linked += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if stack[depth][0] in ("table", "body") and tag in ("p", *INLINE):
                    break
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select") or (stack[depth][0] == "tr" and tag in ("td", "th")):
                    break
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            in_link += tag == "a"
            continue
        flush()
        label, children = _label(tag, m[4] or m[7] or ""), []
        stack[min(len(stack) - 1, DEPTH)][1].append((label, children))
        shape.append(f"({label}")
        stack.append((tag, children))
    put(page[at:])
    leave(1)
    flush()
    return root, blocks, "".join(shape)


def _kind(item) -> str:
    """An item's label and its children's; groups are of their items' kinds."""
    if item[0] == "#":
        return "#"
    if item[0] in ("+", "?"):
        return " ".join(map(_kind, item[1]))
    inside = {x[0] for child in item[1] for x in (child[1] if child[0] in ("+", "?") else (child,))}
    return f"{item[0]}({' '.join(sorted(inside))})"


def _merge(a, b):
    """One item for two that are matched."""
    if a[0] == "#" and b[0] == "#":
        return ("#", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] + b[4])
    marks = {a[0], b[0]} & {"+", "?"}
    if marks:
        inner = align(*(x[1] if x[0] in ("+", "?") else [x] for x in (a, b)))
        return ("+" if "+" in marks else "?", inner)
    words = [x[0].split(".") for x in (a, b)]
    return (a[0] if a[0] == b[0] else ".".join(w for w in words[0] if w in words[1]), align(a[1], b[1]))


def fold(items: list) -> list:
    """The items with neighbouring repeats of a kind, or of up to four kinds in turn, as repeated groups."""
    for period in (1, 2, 3, 4):
        kinds = [_kind(x) for x in items]
        out: list = []
        i = 0
        while i < len(items):
            end = i + period
            while kinds[end : end + period] == kinds[i : i + period] and end + period <= len(items) and (period > 1 or kinds[i] != "#"):
                end += period
            if end > i + period:
                group = items[i : i + period]
                for j in range(i + period, end, period):
                    group = [_merge(x, y) for x, y in zip(group, items[j : j + period], strict=True)]
                out.append(("+", group[0][1] if period == 1 and group[0][0] in ("+", "?") else group))
                i = end
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """One expression for both: matched items merged, others optional or repeats of their neighbours."""
    ka, kb = [_kind(x) for x in a], [_kind(x) for x in b]
    if ka == kb:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    head, most = 0, min(len(a), len(b))
    while head < most and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < most - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    front = [_merge(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    back = [_merge(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return _absorb([*front, *_between(fold(a[head : len(a) - tail]), fold(b[head : len(b) - tail])), *back])


class _Weights:
    """How well the items of two lists match: 4 for equal kinds, 2 for equal labels, 1 for equal tags with equal children
    (class names may be made up for each page, what they say of main text may not differ), else 0."""

    def __init__(self, a: list, b: list) -> None:
        numbers: dict = {}
        marks = [[self._marks(x) for x in items] for items in (a, b)]
        # Marks that a side does not have get numbers of its own, so they equal nothing.
        table = [[[numbers.setdefault((j, m), len(numbers)) if m is not None else -1 - side for j, m in enumerate(own)] for own in items] for side, items in enumerate(marks)]
        self.a, self.b = (np.array(x, np.int64).reshape(-1, 3).T for x in table)

    @staticmethod
    def _marks(item) -> tuple:
        kind = _kind(item)
        x = item[1][0] if item[0] in ("+", "?") and len(item[1]) == 1 else item
        if x[0] in ("+", "?", "#"):
            return kind, None, None
        return kind, x[0], (x[0].split(".")[0], _outside(x[0]), kind[kind.find("(") :])

    def row(self, i: int, low: int, high: int) -> np.ndarray:
        """Item i of the first list against items low to high of the second."""
        kind, label, rough = (self.b[j, low:high] == self.a[j, i] for j in range(3))
        return np.where(kind, 4, np.where(label, 2, rough)).astype(np.int32)


#: Cells of an alignment table that are kept at once; longer lists are split where the heaviest alignment crosses the middle.
TABLE_CELLS = 1 << 22


def _pairs(w: _Weights, a0: int, a1: int, b0: int, b1: int) -> Iterator[tuple[int, int]]:
    """The matched places of the heaviest alignment of items a0 to a1 and b0 to b1, in order."""
    n, m = a1 - a0, b1 - b0
    if not n or not m:
        return
    if n == 1 or (n + 1) * (m + 1) <= TABLE_CELLS:
        best = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n - 1, -1, -1):
            # The running maximum from the right stands for leaving out items of the second list.
            best[i, :m] = np.maximum.accumulate(np.maximum(best[i + 1, :m], best[i + 1, 1:] + w.row(a0 + i, b0, b1))[::-1])[::-1]
        i = j = 0
        while i < n and j < m:
            match = int(w.row(a0 + i, b0 + j, b0 + j + 1)[0])
            if match and best[i, j] == best[i + 1, j + 1] + match:
                yield a0 + i, b0 + j
                i, j = i + 1, j + 1
            elif best[i, j] == best[i + 1, j]:
                i += 1
            else:
                j += 1
        return
    middle = (a0 + a1) // 2
    ahead, behind = np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32)
    for i in range(a1 - 1, middle - 1, -1):
        ahead[:m] = np.maximum.accumulate(np.maximum(ahead[:m], ahead[1:] + w.row(i, b0, b1))[::-1])[::-1]
    for i in range(a0, middle):
        behind[1:] = np.maximum.accumulate(np.maximum(behind[1:], behind[:-1] + w.row(i, b0, b1)))
    at = b0 + int(np.argmax(ahead + behind))
    yield from _pairs(w, a0, middle, b0, at)
    yield from _pairs(w, middle, a1, at, b1)


def _between(a: list, b: list) -> list:
    """The heaviest alignment of two lists in order; a table's rows are made at once, and memory is bounded by ``TABLE_CELLS``."""
    out: list = []
    i = j = 0
    for x, y in (*_pairs(_Weights(a, b), 0, len(a), 0, len(b)), (len(a), len(b))):
        out += [_optional(item) for item in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _optional(item):
    return item if item[0] == "?" else ("?", [item])


def _absorb(items: list) -> list:
    """Groups take in what stands next to them and is of their kind."""
    out: list = []
    for x in items:
        if out and (x[0] in ("+", "?") or out[-1][0] in ("+", "?")) and _kind(x) == _kind(out[-1]) != "#":
            inner = _merge(*(y[1][0] if y[0] == "?" and y[1][0][0] == "+" and len(y[1]) == 1 else y for y in (out[-1], x)))
            out[-1] = ("+", inner[1] if inner[0] in ("+", "?") else [inner])
        else:
            out.append(x)
    return out


def overlay(a: list, b: list) -> list:
    """One expression for two trees of the same shape."""
    return [_merge(x, y) if x[0] == "#" else (x[0], overlay(x[1], y[1])) for x, y in zip(a, b, strict=True)]


def expression(items: list) -> str:
    """The wrapper as a regular expression over tags, constants (=) and text slots (#)."""
    out = []
    for x in items:
        if x[0] == "#":
            out.append("#" if x[1] is None or x[2] < 2 else "=")
        elif x[0] in ("+", "?"):
            out.append(f"({expression(x[1])}){x[0]}")
        else:
            out.append(f"<{x[0]}>{expression(x[1])}</{x[0].split('.')[0]}>")
    return "".join(out)


def _unplaced(items: list) -> list:
    return [(*x[:4], ()) if x[0] == "#" else (x[0], _unplaced(x[1])) for x in items]


def _shape(items: list) -> str:
    """A tree without its texts."""
    return "".join("#" if x[0] == "#" else f"({x[0]}{_shape(x[1])})" for x in items)


class Wrapper:
    """A host's expression and the number of its pages, of which each is given once.

    Trees of one shape are laid over each other first; ``SHAPES`` of them at most wait to be aligned.
    """

    SHAPES = 200

    def __init__(self, pages: int = 0, items: list | None = None) -> None:
        self.pages, self.items, self.waiting = pages, items, {}

    def add(self, tree: list) -> None:
        self.pages += 1
        tree, shape = _unplaced(tree), _shape(tree)
        self.waiting[shape] = overlay(self.waiting[shape], tree) if shape in self.waiting else tree
        if len(self.waiting) >= self.SHAPES:
            self.settle()

    def settle(self) -> None:
        for shape in sorted(self.waiting):
            tree = self.waiting[shape]
            self.items = tree if self.items is None else align(self.items, tree)
        self.waiting = {}

    def join(self, other: Wrapper) -> None:
        self.pages += other.pages
        self.items = other.items if self.items is None else align(self.items, other.items)

    def dump(self) -> str:
        self.settle()
        return json.dumps([self.pages, self.items])

    @staticmethod
    def load(text: str) -> Wrapper:
        pages, items = json.loads(text)
        return Wrapper(pages, _tuples(items))

    def main_blocks(self, tree: list) -> list[int]:
        """The numbers of the page's blocks that land in main slots of the expression."""
        slots: list[tuple[tuple, bool, bool, bool]] = []

        def walk(items: list, out: bool, inside: bool, linked: bool) -> None:
            plain = sum(x[3] for child in items for x in (child[1] if child[0] in ("+", "?") else (child,)) if x[0] == "#")
            for x in items:
                if x[0] == "#":
                    slots.append((x, out, inside, linked))
                elif x[0] in ("+", "?"):
                    walk(x[1], out, inside, linked)
                elif x[0] == "a":
                    # A link where else plain text stands is text; a slot of links is none.
                    walk(x[1], out, inside, x[1][0][3] >= plain)
                else:
                    walk(x[1], out or _outside(x[0]), inside or x[0].split(".")[0] in MAIN, linked)

        walk(align(self.items, tree), False, False, False)
        # Only this page's own texts were counted twice.
        able = [(x, inside) for x, out, inside, linked in slots if not out and not linked]
        main = any(inside for _, inside in able)
        varied = any(x[1] is None for x, _ in able)

        def constant(x: tuple) -> bool:
            return varied and x[1] is not None and x[2] - len(x[4]) >= max(3, self.pages / 2)

        return sorted(i for x, inside in able if inside or not main and not constant(x) for i in x[4])


def _tuples(x: list) -> list:
    return [("#", *y[1:4], ()) if y[0] == "#" else (y[0], _tuples(y[1])) for y in x]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; the empty text without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _merged(df: DataFrame, by: list[str]) -> DataFrame:
    def run(key, frame):
        import pandas as pd

        whole = Wrapper()
        for text in frame["wrapper"].sort_values():
            whole.join(Wrapper.load(text))
        return pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "wrapper": [whole.dump()]})

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {'string' if c == 'host' else 'int'}" for c in by) + ", wrapper string")


def infer(df: DataFrame, url: str = "url", page: str = "html", *, shares: int = 64) -> DataFrame:
    """(host, wrapper as JSON) for each host of ``df``."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(_unplaced(read(x)[0]), separators=(",", ":")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId() % shares
        hosts: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(hosts), pa.string()), pa.array([share] * len(hosts), pa.int32()), pa.array([w.dump() for w in hosts.values()], pa.string())],
                ["host", "share", "wrapper"],
            )
            hosts.clear()
            return made

        for batch in batches:
            for host, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hosts.setdefault(host, Wrapper()).add(_tuples(json.loads(tree)))
                if len(hosts) > 2000:
                    yield out()
        yield out()

    # Pages of one tree, texts' hashes included, are one page wherever they lie; copies meet as one row a task at most.
    distinct = df.select(host_of(df[url]).alias("host"), df[page].alias("page")).where("page <> ''").mapInArrow(trees, "host string, tree string").distinct()
    local = distinct.mapInArrow(run, "host string, share int, wrapper string")
    return _merged(_merged(local, ["host", "share"]).select("host", "wrapper"), ["host"])


def wrapper_expressions(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, pages, expression) for each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Wrapper.load(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.pages for w in made], pa.int64()), pa.array([expression(w.items or []) for w in made])], ["host", "pages", "expression"])

    return infer(df, url, page).mapInArrow(run, "host string, pages long, expression string")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks) for every row of ``df``."""
    found = cut(infer(df, url, page))
    size = found.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    slim = df.select(df[key].alias("key"), df[url].alias("url"), df[page].alias("page"), host_of(df[url]).alias("host"))
    kind = slim.schema[0].dataType.simpleString()
    small = size <= BROADCAST_BYTES
    if small:
        table = {r["host"]: r["wrapper"] for r in found.toLocalIterator()}
        sent = df.sparkSession.sparkContext.broadcast(table)
        source = slim.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        sent = None
        source = slim.join(found, "host", "left").select("key", "url", "page", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts, counts = [], []
            for at in range(len(batch)):
                text = batch.column(2)[at].as_py()
                chosen: list[str] = []
                if text:
                    host = batch.column(3)[at].as_py()
                    if host not in known:
                        if len(known) > 500:
                            known.clear()
                        known[host] = Wrapper.load(sent.value[host] if sent else batch.column(4)[at].as_py())
                    tree, blocks, _ = read(text)
                    chosen = [blocks[i] for i in known[host].main_blocks(tree)]
                texts.append("\n".join(chosen))
                counts.append(len(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                [key, url, "text", "n_chars", "n_blocks"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long, n_blocks long")

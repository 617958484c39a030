"""The manifest against a plain recursion over all rows, on the tables and on defined cases."""

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wearline.llm import merkle
from wearline.llm.oracles import ORACLES
from wearline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"
SHOWN = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf_of(row), row))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels_of([x[1] for x in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for rank, g in enumerate(order):
        for i, (key, own, row) in enumerate(groups[g]):
            start = own
            if key is not None and zlib.crc32(str(key).encode()) % 7 == 0:
                start = leaf_of((*row[:3], None if row[3] is None else row[3] + 1, row[4]))
            siblings = []
            for levels, place in ((trees[g], i), (top, rank)):
                for level in levels[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else ""
                    siblings.append(other)
                    start = digest(other, start) if place % 2 else digest(start, other)
                    place //= 2
            out.append((key, own, trees[g][-1][0], top[-1][0], digest(*siblings), start, start == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **more):
    return sorted((tuple(r) for r in merkle.document_proofs(docs, **more).select(*SHOWN).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_defined_cases_and_sizes_around_subtrees(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(70)] + [(i, "s", "de", i, "é" * i) for i in range(100, 133)] + [(i, None, "fr", 1, "") for i in range(200, 204)]
    rows += [(300, "a", None, 3, None), (None, "a", "en", 3, "x"), (None, "a", "en", 3, "x"), (301, "a", "", None, "y"), (7, "b", "en", 1, "again"), (7, "b", "en", 1, "again")]
    rows += [(400 + i, "s", f"lang{i}", None if i % 2 else i, "x" * 300_000 if i == 5 else "z") for i in range(35)]
    docs = table(spark, rows).withColumns({c: F.lit("other") for c in ("grp", "h", "i", "n", "path", "root", "key", "_tie")})
    want = plain(rows)
    assert found(docs) == want and any(not r[-1] for r in want)
    assert found(docs, step=3) == want


def test_one_leaf_and_no_rows(spark):
    one = table(spark, [(1, "s", "en", 2, "ab")])
    (row,) = merkle.document_proofs(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == [] and row["verified"] and row["proof_sha256"] == digest("")
    assert merkle.document_proofs(one.where("doc_id > 1")).count() == 0


def test_only_every_few_levels_are_stored(spark):
    leaves = merkle.placed(table(spark, [(i, "s", "en", i, "t") for i in range(1000)]).select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), merkle.leaf(F.col("doc_id")).alias("h")))
    stored = merkle.tree(leaves, ["key"], 4)
    assert len(stored.levels) == 3  # 1000 leaves have ten levels above them
    assert [x.select(F.explode("children")).count() for x in stored.levels] == [1000, 63, 4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, DATA).select(*SHOWN).collect()), key=str)
    assert got == sorted(con.execute(ORACLES["op11_merkle_manifest"]).fetchall(), key=str)
    docs = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert got == plain(docs)

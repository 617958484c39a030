"""A Merkle manifest of a table that stores only every few levels and recomputes the rest for proofs.

A leaf is the digest of a row's fields (``-`` for null, else the UTF-8 byte count, ``:`` and the
value).  Within a group leaves ascend by key; while several nodes remain, every two neighbours (a
lone last one by itself) become the digest of their hex digests.  What remains is the group's
subroot; the subroots, ordered by group, form a tree of the same kind, whose last node is the root.

* Leaves get their places from one range exchange (group, key, leaf): the sorted rows are written,
  rows per partition and group are counted, and a leaf's place is its place in the partition plus
  the counts before.  No group is gathered, and rows equal in all columns are split too.
* ``step`` levels are built at once: 2 ** step neighbours are one row with an array, an aligned
  subtree, whose inner nodes are made by array functions and dropped again; only its top goes on.
  The stored levels 0, step, 2 step, ... are written tables in the shared folder.
* Proofs go down from the top: each stored subtree is read again, its inner nodes are made once
  more, each child gets its siblings within the subtree and, by a join of one row per subtree, its
  parent's siblings.  The siblings of a leaf exist only while its row is made.

Defined cases: a null key comes first among its group's keys, a null group first among groups; rows
equal in key are ordered by leaf; repeated rows are leaves of their own; null fields are ``-``; a
null text and an empty one differ; an empty table has no rows and no root; columns that are no
fields are ignored, whatever their names; texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.session import cut
from wearline.sources.tables import work_dir, write_parquet

#: One step makes subtrees of 32 nodes.
STEP = 5


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated inputs."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length in front, so that no two different rows read the same."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*(field(c) for c in fields))


def placed(rows: DataFrame) -> DataFrame:
    """Adds to (grp, key, h, ...) each row's place ``i`` among its group by (key, h), and the group's size ``n``."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = cut(dealt.repartitionByRange("grp", "key", "h", "_tie").sortWithinPartitions("grp", "key", "h").drop("_tie"))
    numbered = ordered.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    before = Window.partitionBy("grp").orderBy("_part")
    counts = numbered.groupBy("grp", "_part").agg(F.count("*").alias("_own"), F.min("_at").alias("_first"))
    starts = counts.select(
        "grp", "_part", (F.sum("_own").over(before) - F.col("_own") - F.col("_first")).alias("_shift"), F.sum("_own").over(Window.partitionBy("grp")).alias("n")
    )
    return numbered.join(starts, ["grp", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: how often the number must be halved, rounded up, to be 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _parents(nodes: Column) -> Column:
    pair = lambda j: F.sha2(F.concat(F.get(nodes, 2 * j), F.coalesce(F.get(nodes, 2 * j + 1), F.lit(""))).cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), pair)


def _subtrees(nodes: DataFrame, step: int, carried: Sequence[str]) -> DataFrame:
    """One row per aligned subtree of 2 ** step neighbours: (grp, n, i, children in order)."""
    child = F.struct("i", "h", *carried)
    return nodes.groupBy("grp", "n", F.shiftright("i", step).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children")).withColumnRenamed("up", "i")


def _grown(subtrees: DataFrame, base: int, step: int) -> DataFrame:
    """Adds the subtree's own levels ``l0`` to ``l{step}``; levels above the group's last node repeat it."""
    out = subtrees.withColumns({"left": F.greatest(_depth(F.col("n")) - base, F.lit(0)), "l0": F.col("children.h")})
    for k in range(step):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("left") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out


def _siblings(place: Column, step: int) -> Column:
    """What a child at ``place`` of its subtree is hashed with, level by level: sibling (empty if it has none) and its side."""
    steps = [
        F.struct(F.coalesce(F.get(F.col(f"l{k}"), F.shiftright(place, k).bitwiseXOR(F.lit(1))), F.lit("")).alias("h"), (F.shiftright(place, k) % 2 == 1).alias("left"))
        for k in range(step)
    ]
    return F.slice(F.array(*steps), F.lit(1), F.least(F.col("left"), F.lit(step)))


@dataclass
class Tree:
    """The stored levels of the trees of all groups, from the leaves up, and each group's last node."""

    levels: list[DataFrame]
    tops: DataFrame
    step: int

    def proofs(self, above: DataFrame) -> DataFrame:
        """(grp, the leaf's columns, path) for all leaves; ``above`` has the path from the group's last node on."""
        told = None
        for number in range(len(self.levels) - 1, -1, -1):
            blocks = _grown(self.levels[number], number * self.step, self.step)
            if told is None:
                joined = blocks.join(above.withColumnRenamed("path", "rest"), "grp")
            else:
                joined = blocks.join(told.select("grp", "i", F.col("path").alias("rest")), ["grp", "i"])
            inner = [c for c in joined.columns if c not in ("children", "i")]
            each = joined.select(*inner, F.posexplode("children").alias("_place", "_child"))
            path = F.concat(_siblings(F.col("_place"), self.step), F.col("rest"))
            told = each.select("grp", "_child.*", path.alias("path"))
        return told


def tree(leaves: DataFrame, carried: Sequence[str] = (), step: int = STEP) -> Tree:
    """Builds and stores the trees of placed leaves (grp, i, n, h and the columns to carry); see ``placed``."""
    spark = leaves.sparkSession
    folder = work_dir(spark, "merkle")
    levels, nodes, kept = [], leaves, list(carried)
    while True:
        base = len(levels) * step
        write_parquet(_subtrees(nodes, step, kept), f"{folder}/{base}")
        stored = spark.read.parquet(f"{folder}/{base}")
        levels.append(stored)
        nodes = _grown(stored, base, step).select("grp", "n", "i", F.element_at(f"l{step}", 1).alias("h"))
        if not stored.where("i > 0").limit(1).count():
            return Tree(levels, nodes.select("grp", "h"), step)
        kept = []


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    joined = lambda acc, x: F.when(x["left"], F.concat(x["h"], acc)).otherwise(F.concat(acc, x["h"]))
    return F.aggregate(path, start, lambda acc, x: F.sha2(joined(acc, x).cast("binary"), 256))


def manifest(rows: DataFrame, carried: Sequence[str] = (), step: int = STEP) -> DataFrame:
    """Proofs for rows (grp, key, h and the columns to carry): these with subroot, root and path.

    ``grp`` may be null; (key, h) orders the leaves of a group.
    """
    tagged = rows.withColumn("grp", F.coalesce(F.concat(F.lit("+"), F.col("grp").cast("string")), F.lit("")))
    lower = tree(placed(tagged), ["key", *carried], step)
    tops = placed(lower.tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "h"))
    upper = tree(tops, ["key"], step)
    over = upper.tops.select(F.lit("").alias("grp"), F.array().cast("array<struct<h:string,left:boolean>>").alias("path"))
    root = upper.tops.select(F.col("h").alias("root")).first()
    above = upper.proofs(over).select(F.col("key").alias("grp"), F.col("h").alias("subroot"), F.lit(root and root[0]).cast("string").alias("root"), "path")
    above = above.select("grp", F.struct("subroot", "root").alias("_ends"), "path")
    ends = above.select("grp", "_ends")
    found = lower.proofs(above.select("grp", "path")).join(ends, "grp")
    group = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    return found.select(group.alias("grp"), "key", "h", *carried, F.col("i").alias("place"), "_ends.subroot", "_ends.root", "path")


def document_proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), count: str = "n_chars", share: int = 7, step: int = STEP) -> DataFrame:
    """Each document's leaf and proof, and what its proof gives after a simulated change of one row in ``share``.

    A row is changed where ``share`` divides the crc32 of its key: ``count`` grows by 1 (a null one
    stays null).  ``path`` holds the siblings from the leaf to the root, each with its side.
    """
    own = [docs[c] for c in fields]
    changed = [docs[c] + 1 if c == count else docs[c] for c in fields]
    hit = F.crc32(docs[key].cast("string").cast("binary")) % share == 0
    rows = docs.select(docs[group].alias("grp"), docs[key].alias("key"), leaf(*own).alias("h"), F.when(hit, leaf(*changed)).alias("told"))
    found = manifest(rows, ["told"], step)
    return found.select(
        F.col("key").alias(key), F.col("grp").alias(group), F.col("h").alias("leaf"), "subroot", "root", "path",
        digest(F.array_join("path.h", "")).alias("proof_sha256"), folded(F.coalesce("told", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

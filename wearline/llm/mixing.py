"""Mixing sources to target weights by Pfair scheduling of blocks.

Rows of a source are dealt into blocks of ``block_chars`` characters.  Time is a row of slots, one
block each.  Block i (from 1) of a source of weight w may be sent from slot ``floor((i - 1) / w)``
on and must be sent before slot ``ceil(i / w)``; among the released blocks the earliest deadline
goes first.  Weights of one processor sum to 1, so this meets all deadlines, and after any slot
each source has sent less than one block more or less than its weight asks for.  Weights are taken
as exact fractions, never rounded.  When a source ends, the rest goes on in proportion: a new phase
begins, in which windows count from its first slot.

The plan is made on the driver from one total per source and then broadcast, so its size is bounded:
a block has ``block_chars`` characters, or more where the input would else have over ``max_blocks``
blocks.  Where a row stands in its source is a prefix sum over cells of about ``rows_per_cell``
rows, itself summed in two levels; no task holds a source.

No row is dropped or repeated.  Defined cases: a null source is a source of its own; a null or
empty text counts one character; a text longer than a block takes the blocks it covers; rows with
equal keys are placed each for itself, equal rows in any order; a source without a target weight
has the smallest given weight; weights must be positive and finite; other columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS_IN_GROUP = 1000


def plan(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction]) -> pa.Table:
    """(of, number, slot, release, deadline) of every block: earliest deadline first among the released blocks.

    Sources are named in the order of ``blocks``; ties of deadlines go by that order.
    """
    names = list(blocks)
    if not all(math.isfinite(weights[s]) and weights[s] > 0 for s in names):
        raise ValueError("weights must be positive and finite")
    exact = [Fraction(weights[s]) for s in names]
    unit = math.lcm(*(x.denominator for x in exact)) if exact else 1
    share = [int(x * unit) for x in exact]
    total, done, slot = [blocks[s] for s in names], [0] * len(names), 0
    live = [s for s in range(len(names)) if total[s]]
    out = np.zeros((sum(total), 5), np.int64)
    while live:
        start, whole, first = slot, sum(share[s] for s in live), list(done)
        waiting = [(0, s) for s in live]
        ready: list[tuple[int, int]] = []
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= slot - start:
                _, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * whole // share[s]), s))
            deadline, s = heapq.heappop(ready)
            i = done[s] - first[s]
            out[slot] = s, done[s], slot, start + i * whole // share[s], start + deadline
            done[s] += 1
            slot += 1
            ended = done[s] == total[s]
            heapq.heappush(waiting, ((i + 1) * whole // share[s], s))
        live = [s for s in live if done[s] < total[s]]
    of = pa.array(names, pa.string()).take(pa.array(out[:, 0]))
    return pa.table([of, *(pa.array(out[:, j]) for j in range(1, 5))], ["of", "number", "slot", "release", "deadline"])


def _placed(
    df: DataFrame, key: str, source: str, text: str, size: str | None, weights: Mapping[str | None, float] | None, temperature: float,
    block_chars: int, rows_per_cell: int, max_blocks: int,
) -> DataFrame:
    """``row`` (all columns of df) with block, slot, release, deadline and offset.

    If ``size`` names a column with the text's length, ``text`` names one with its hash.
    """
    spark = df.sparkSession
    named = F.when(df[source].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), df[source].cast("string")))
    length = df[size] if size else F.length(df[text])
    base = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("row"), named.alias("src"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("size"),
        F.xxhash64(df[key], df[text] if size else F.xxhash64(df[text])).alias("h"),
    )
    totals = base.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).orderBy("src").collect()
    block_chars = max(block_chars, -(-sum(r["chars"] for r in totals) // max_blocks))
    cells = max(4, sum(r["n"] for r in totals) // rows_per_cell)
    base = base.withColumn("cell", F.pmod(F.shiftright("h", 20), F.lit(cells)))
    # Characters before a cell: those before its group of cells, and those before it in the group.
    own = base.groupBy("src", "cell").agg(F.sum("size").alias("chars")).withColumn("group", F.floor(F.col("cell") / CELLS_IN_GROUP))
    groups = own.groupBy("src", "group").agg(F.sum("chars").alias("all"))
    groups = groups.select("src", "group", (F.sum("all").over(Window.partitionBy("src").orderBy("group")) - F.col("all")).alias("earlier"))
    inside = F.sum("chars").over(Window.partitionBy("src", "group").orderBy("cell")) - F.col("chars")
    offsets = own.withColumn("inside", inside).join(groups, ["src", "group"]).select("src", "cell", (F.col("earlier") + F.col("inside")).alias("before"))
    blocks = {r["src"]: -(-r["chars"] // block_chars) for r in totals}
    if weights is None:
        target = {r["src"]: r["chars"] ** temperature for r in totals}
    else:
        given = {("" if s is None else f"={s}"): w for s, w in weights.items()}
        target = {r["src"]: given.get(r["src"], min(given.values())) for r in totals}
    planned = spark.createDataFrame(plan(blocks, target))  # max_blocks rows and one for each source at most
    within = Window.partitionBy("src", "cell").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        base.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["src", "cell"])
        .withColumn("at", F.col("before") + F.col("inner"))
        .withColumn("block", F.floor(F.col("at") / block_chars))
    )
    return (
        located.join(F.broadcast(planned), (F.col("src") == F.col("of")) & (F.col("block") == F.col("number")))
        .select("row", "block", (F.col("at") - F.col("block") * block_chars).alias("offset"), "slot", "release", "deadline")
    )


def schedule(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, weights: Mapping[str, float] | None = None,
    temperature: float = 0.5, block_chars: int = 100_000, rows_per_cell: int = 2_000, max_blocks: int = 1_000_000,
) -> DataFrame:
    """Where each row goes: key, source, block, slot, release, deadline, offset_in_block.

    Rows in the order of (slot, offset_in_block) are the mix.  ``weights`` are targets by source;
    without them a source weighs its characters to the power of ``temperature``.
    """
    slim = df.select(df[key].alias("k"), df[source].alias("s"), F.length(df[text]).alias("size"), F.xxhash64(df[text]).alias("t"))
    placed = _placed(slim, "k", "s", "t", "size", weights, temperature, block_chars, rows_per_cell, max_blocks)
    return placed.select(
        F.col("row.k").alias(key), F.col("row.s").alias(source), "block", "slot", "release", "deadline", F.col("offset").alias("offset_in_block")
    )


def interleave(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, weights: Mapping[str, float] | None = None,
    temperature: float = 0.5, block_chars: int = 100_000, rows_per_cell: int = 2_000, max_blocks: int = 1_000_000,
) -> DataFrame:
    """All rows and columns of ``df``, in the order of the mix: partitions are ranges of slots, sorted within."""
    placed = _placed(df, key, source, text, None, weights, temperature, block_chars, rows_per_cell, max_blocks)
    return placed.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset").select("row.*")


def with_slots(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, weights: Mapping[str, float] | None = None,
    temperature: float = 0.5, block_chars: int = 100_000, rows_per_cell: int = 2_000, max_blocks: int = 1_000_000,
) -> DataFrame:
    """All rows and columns of ``df`` with slot and offset_in_block (columns of these names are replaced), in any order; their order is the mix."""
    placed = _placed(df, key, source, text, None, weights, temperature, block_chars, rows_per_cell, max_blocks)
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("slot", "offset_in_block")]
    return placed.select(*kept, "slot", F.col("offset").alias("offset_in_block"))

"""Exact quantiles by counting ranges and narrowing those that hold a wanted rank.

All columns and groups are selected together.  The first pass counts values per logarithmic range
(about 64 ranges for a factor of e, so the whole span of doubles is some 190,000 of them); ranges
are few, so the sums before them are a small window.  Only the ranges that hold a wanted rank go on:
each further pass cuts them into 65,536 equal parts, or, when few values are left, takes the
distinct values themselves.  A range whose least and greatest value agree is done.  No task and no
buffer ever holds a column's values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.operators.prefix import join_same
from wearline.sources.tables import stored

#: Equal parts of a narrowed range, and the number of values in a range that are told apart at once.
PARTS = 65_536
LOG_RANGES = 64
#: Above the logarithm of any double, in ranges.
BEYOND = 50_000


def _log_range(v: Column) -> Column:
    """Numbers that rise with the value; NaN is above all."""
    size = F.floor(F.ln(F.abs(v)) * LOG_RANGES) + BEYOND
    top = F.lit(2 * BEYOND)
    finite = F.when(F.abs(v) == float("inf"), top).otherwise(size)
    return F.when(F.isnan(v), top + 1).when(v == 0, 0).when(v > 0, finite).otherwise(-finite).cast("double")


def _wanted(total: Column, percents: Sequence[float]) -> Column:
    """Ranks (from 0) on both sides of each wanted place."""
    places = [F.lit(float(p)) * (total - 1) for p in percents]
    return F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in places))))


def _hit(counted: DataFrame, keys: Sequence[str], ranks: Column) -> DataFrame:
    """Of counted cells (keys, cell, n, lo, hi, offset), those that hold a wanted rank, one row per rank."""
    w = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.col("offset") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return placed.withColumn("ranks", inside).where(F.size("ranks") > 0)


def quantiles(df: DataFrame, columns: Sequence[str], percents: Sequence[float], by: Sequence[str] = (), written: bool = False) -> DataFrame:
    """(by, column_name, q): per group and column with a value the quantiles at ``percents``, linear between neighbours.

    ``written`` says that ``df`` is cheap to read again; else its columns are written once.  Nulls count for nothing, NaN as the
    greatest value, null groups are groups.
    """
    narrow = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    narrow = narrow if written else stored(narrow)
    long = narrow.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns)))).where("v is not null")
    keys = [*by, "column_name"]
    counts = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = long.groupBy(*keys, _log_range(F.col("v")).alias("cell")).agg(*counts).withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("offset", F.lit(0))
    found = [stored(_hit(first, keys, _wanted(F.col("total"), percents)).select(*keys, "total", "ranks", "before", "n", "lo", "hi"))]
    while found[-1].where("lo < hi").limit(1).count():
        open_ranges = found[-1].where("lo < hi").withColumnRenamed("n", "many")
        open_ranges = open_ranges.select(*keys, "total", "ranks", F.col("before").alias("offset"), "many", F.col("lo").alias("from"), F.col("hi").alias("to"))
        inside = join_same(long, open_ranges, keys, F.col("v").between(F.col("from"), F.col("to")))
        part = F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * PARTS).cast("double")
        cell = F.when(F.col("many") <= PARTS, F.col("v")).otherwise(part)
        inner = inside.groupBy(*keys, "from", "total", "ranks", "offset", cell.alias("cell")).agg(*counts)
        found.append(stored(_hit(inner, [*keys, "from"], F.col("ranks")).select(*keys, "total", "ranks", "before", "n", "lo", "hi")))
    done = reduce(DataFrame.unionByName, found).where("not lo < hi").select(*keys, "total", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    known = done.groupBy(*keys, "total").agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("known"))

    def at(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = (F.element_at("known", f(place)) for f in (F.floor, F.ceil))
        return F.when(F.floor(place) == F.ceil(place), low).when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return known.select(*keys, F.array(*(at(p) for p in percents)).alias("q"))


def quantile_edges(df: DataFrame, column: str, bins: int, written: bool = False) -> DataFrame:
    """One row with the distinct quantile edges of ``column``; none without values."""
    found = quantiles(df, [column], [i / bins for i in range(bins + 1)], written=written)
    return found.select(F.array_sort(F.array_distinct("q")).alias("edges"))

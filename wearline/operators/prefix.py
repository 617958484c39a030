"""Running sums and ranks over whole groups of any size, from ranges that tasks handle apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.sources.tables import stored


def join_same(left: DataFrame, right: DataFrame, columns: Sequence[str], more: Column | None = None) -> DataFrame:
    """Inner join on equal columns, null with null, and a further condition."""
    named = {c: f"_other_{c}" for c in columns}
    condition = F.lit(True) if more is None else more
    for c, other in named.items():
        condition = condition & F.col(c).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(named), condition).drop(*named.values())


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], amounts: dict[str, Column]) -> DataFrame:
    """Adds, for each named amount, its sum over the group's rows up to and including each row, and ``total_<name>`` over the group.

    The rows are read once: they are dealt into ranges of (group, order) and written with their range's number.  Ranges are
    summed, sums before a range are a window over at most as many rows as there are ranges, and inside of a range an ordinary
    window runs.  So neither a group nor the table meets in one task.  Rows equal in group and order share a range and follow each
    other in any order; null groups and null amounts (counted as 0) are allowed; an empty table gives an empty result.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    own = {f"_own_{n}": F.coalesce(a, F.lit(0)) for n, a in amounts.items()}
    dealt = rows.withColumns(own).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    kept = stored(dealt)
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = kept.groupBy(*by, "_range").agg(*(F.sum(c).alias(c) for c in own))
    offsets = sums.select(
        *by, "_range", *(F.coalesce(F.sum(f"_own_{n}").over(upto), F.lit(0)).alias(f"_before_{n}") for n in amounts),
        *(F.sum(f"_own_{n}").over(whole).alias(f"total_{n}") for n in amounts),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = kept.withColumns({n: F.sum(f"_own_{n}").over(inside) for n in amounts})
    return join_same(local, offsets, [*by, "_range"]).withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in amounts}).drop("_range", *own, *(f"_before_{n}" for n in amounts))


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Adds each row's place (from 1) in its group and the group's size as ``total_<name>``."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")})

"""From wide rows with indexed slots to events, and deduplication."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.functions.columns import clamp, to_date, to_number


def indexed(columns: Sequence[str], base: str) -> list[tuple[int, str]]:
    """(slot, column) of the columns ``base_1``, ``base_2`` and so on, by slot."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(base) + r"_(\d+)", c))]
    return sorted(found)


def spelling(columns: Sequence[str], *bases: str) -> str:
    """The first of the spellings that the columns use."""
    return next((b for b in bases if indexed(columns, b)), bases[0])


def near_length(c: Column, length: float) -> Column:
    return F.abs(c - length) <= 1e-8 + 1e-5 * length


def measurements_long(
    wide: DataFrame, keep: Sequence[str], *, date: str = "PTM_pvm", second: str = "Iri", value: str = "Ura_max", length: str | None = "Pituus",
    segment_length: float = 100.0, first_year: int = 2005, value_limit: float = 40.0, second_limit: float = 10.0,
) -> DataFrame:
    """One row per valid measurement slot, in one pass over the wide row."""
    if length in wide.columns:
        wide = wide.where(near_length(to_number(F.col(length)), segment_length))
    have = set(wide.columns)

    def column(base: str, i: int) -> Column:
        return F.col(f"{base}_{i}") if f"{base}_{i}" in have else F.lit(None).cast("string")

    slots = F.array(*(
        F.struct(
            F.lit(i).alias("slot_idx"), to_date(F.col(c)).alias("event_date"), clamp(to_number(column(second, i)), 0, 20).alias("IRI"), clamp(to_number(column(value, i)), 0, 80).alias("URA"),
        )
        for i, c in indexed(wide.columns, date)
    ))
    rows = wide.select(*keep, F.inline(slots))
    return rows.where(
        (F.year("event_date") >= first_year) & F.col("URA").isNotNull() & F.col("IRI").isNotNull() & (F.col("IRI") <= second_limit) & (F.col("URA") <= value_limit)
    ).withColumns({"event_type": F.lit("PTM"), "event_order": F.lit(1)})


def treatments_long(wide: DataFrame, keep: Sequence[str], *, date: str = "Tp_pvm", surface: str = "Tp_pinta", methods: Sequence[str] = ("Tp_työmen", "Tp_tyomen"), length: str | None = "Pituus", segment_length: float = 100.0, first_year: int = 2005) -> DataFrame:
    """One row per valid treatment slot; dates of 1900 are placeholders for none."""
    if length in wide.columns:
        wide = wide.where(near_length(to_number(F.col(length)), segment_length))
    have, method = set(wide.columns), spelling(wide.columns, *methods)

    def column(base: str, i: int) -> Column:
        return F.col(f"{base}_{i}") if f"{base}_{i}" in have else F.lit(None).cast("string")

    slots = F.array(*(
        F.struct(F.lit(i).alias("slot_idx"), to_date(F.col(c)).alias("event_date"), column(surface, i).alias("Tp_pinta"), column(method, i).alias("Tp_tyomen"))
        for i, c in indexed(wide.columns, date)
    ))
    rows = wide.select(*keep, F.inline(slots))
    valid = (F.year("event_date") != 1900) & (F.year("event_date") >= first_year)
    return rows.where(valid).withColumns({"event_type": F.lit("TP"), "event_order": F.lit(0)})


def union_events(measurements: DataFrame, treatments: DataFrame) -> DataFrame:
    return measurements.unionByName(treatments, allowMissingColumns=True)


def first_measurements(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One measurement per key, date and slot, the one of the smallest values."""
    w = Window.partitionBy(*keys, "event_date", "event_type", "slot_idx").orderBy(F.col("IRI").asc_nulls_last(), F.col("URA").asc_nulls_last())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_treatments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates([*keys, "event_date", "event_type", "slot_idx", "Tp_pinta", "Tp_tyomen"])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs with margins (``All``) and the share within each ``a``."""
    counted = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    own = F.sum(F.when(F.col("gb") == 0, F.col("n"))).over(Window.partitionBy("ga", a))
    return counted.select(
        F.when(F.col("ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "All").otherwise(F.col(b).cast("string")).alias(b), "n",
        (F.col("n") / own).alias("row_share"),
    )


def pivoted(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: Column) -> DataFrame:
    """A pivot with stated values, so no pass over the data looks for them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure)


def feature_lists(spark, mixtures: dict[str, Sequence[str]]) -> DataFrame:
    rows = [(k, len(v), ", ".join(v)) for k, v in mixtures.items()]
    return spark.createDataFrame(rows, "feature_mixture string, n_features int, features string")

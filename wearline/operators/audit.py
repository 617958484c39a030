"""Profiles and integrity figures of a history or training table, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.functions.columns import cut_bins
from wearline.operators.prefix import running_sums
from wearline.operators.quantiles import quantiles
from wearline.sources.tables import stored

INF = float("inf")
# Bins of gaps (years) and of previous levels.
GAP_EDGES, GAP_LABELS = [0, 0.75, 1.5, 2.5, 4, 10, INF], ["<=0.75y", "0.75-1.5y", "1.5-2.5y", "2.5-4y", "4-10y", "10y+"]
LEVEL_EDGES, LEVEL_LABELS = [-INF, 5, 10, 15, 20, 25, 30, 40, INF], ["<=5", "5-10", "10-15", "15-20", "20-25", "25-30", "30-40", "40+"]
# Thresholds of the drop sweeps.
SWEEP, CORROBORATED = (-1, -2, -3, -4, -5, -6, -8, -10), (-2, -3, -4, -5, -6)
# Out-of-range rules (name, column, comparison, bound).
RANGE_RULES = (
    ("IRI < 0", "IRI", "<", 0), ("IRI > 20", "IRI", ">", 20), ("URA < 0", "URA", "<", 0), ("URA > 80", "URA", ">", 80),
    ("Delta_t_days < 0", "Delta_t_days", "<", 0), ("Pavement_Age_years < 0", "Pavement_Age_years", "<", 0),
    ("tp_count_interval < 0", "tp_count_interval", "<", 0), ("Minor_TP_Count < 0", "Minor_TP_Count", "<", 0),
    ("days_since_prev_meas < 0", "days_since_prev_meas", "<", 0), ("days_until_next_meas < 0", "days_until_next_meas", "<", 0),
)


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def tall(df: DataFrame, names: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row table's columns as rows."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(n).alias(name), F.col(f"`{n}`").cast("double").alias(value)) for n in names))))


def range_audit(df: DataFrame, rules: Sequence[tuple] = RANGE_RULES) -> DataFrame:
    rules = [r for r in rules if r[1] in df.columns]
    counts = df.agg(*(F.count_if(F.col(c) < b if op == "<" else F.col(c) > b).alias(n) for n, c, op, b in rules))
    return tall(counts, [r[0] for r in rules], "rule", "count").withColumn("count", F.col("count").cast("long"))


def missing(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing count and percent per column (and group)."""
    per = df.groupBy(*by).agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns))
    return per.select(*by, "_rows", F.inline(rows)).select(*by, "column_name", "missing", F.when(F.col("_rows") > 0, F.col("missing") / F.col("_rows") * 100).alias("missing_pct"))


def describe(df: DataFrame, columns: Sequence[str], percents: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """count, mean, std, min, exact percentiles and max per column."""
    df = stored(df.select(*columns))
    facts = [
        F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
        for c in columns
    ]
    found = df.agg(F.array(*facts).alias("a")).select(F.inline("a")).join(quantiles(df, columns, percents, written=True), "column_name", "left")
    return found.select("column_name", "count", "mean", "std", "min", *(F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(percents)), "max")


def extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = stored(df.select(*columns))
    facts = [
        F.struct(F.lit(c).alias("column_name"), F.count(c).alias("non_null"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.count_if(F.col(c) < 0).alias("negative"), F.count_if(F.col(c) == 0).alias("zero"))
        for c in columns
    ]
    medians = quantiles(df, columns, [0.5], written=True).select("column_name", F.col("q")[0].alias("median"))
    return df.agg(F.array(*facts).alias("a")).select(F.inline("a")).join(medians, "column_name", "left")


def value_counts(df: DataFrame, column: str, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of values, nulls included (as ``missing``); the ``top`` most frequent."""
    counted = df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias(column)).agg(F.count("*").alias("count"))
    shared = counted.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))
    return shared.orderBy(F.desc("count"), column).limit(top) if top else shared


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins over the column's whole range, the last one closed: bin (from 0), low edge, count, share within the group."""
    limits = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    x = df.where(F.col(column).isNotNull()).join(F.broadcast(limits))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = x.groupBy(*by, number.alias("bin"), (F.col("_lo") + number * width).alias("low")).agg(F.count("*").alias("count"))
    return counted.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def winsorised(df: DataFrame, column: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Adds ``column_w``: values beyond the quantile limits moved to them (min and max where those coincide)."""
    q = quantiles(df, [column], [0.0, low, high, 1.0]).select("q")
    at = lambda i: F.col("q")[i]
    limits = q.select(F.when(at(1) < at(2), at(1)).otherwise(at(0)).alias("_lo"), F.when(at(1) < at(2), at(2)).otherwise(at(3)).alias("_hi"))
    x = df.join(F.broadcast(limits), how="left")
    return x.withColumn(f"{column}_w", F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def ecdf(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Share of the group's rows at or below each distinct value."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    found = running_sums(per, by, [value], {"n": F.col("_n")})
    return found.select(*by, value, (F.col("n") / F.col("total_n")).alias("cdf"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, over rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda x, a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x))
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(both(a, a, b), both(b, a, b)).alias("corr"), F.count(both(a, a, b)).alias("n")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows share their key with another one."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_keys"))


def interval_groups(measurements: DataFrame) -> DataFrame:
    return measurements.where("delta_URA is not null and delta_IRI is not null and has_TP_interval is not null")


def drop_summary(measurements: DataFrame) -> DataFrame:
    x = interval_groups(measurements)
    per = x.groupBy(F.when(F.col("has_TP_interval"), "TP in interval").otherwise("No TP in interval").alias("tp_interval_group")).agg(
        F.count("*").alias("n"), share(F.col("delta_URA") < 0).alias("ura_negative_share"), share(F.col("delta_URA") <= -1).alias("ura_le_minus_1_share"),
        share(F.col("delta_URA") <= -3).alias("ura_le_minus_3_share"), share(F.col("delta_IRI") < 0).alias("iri_negative_share"), F.avg("delta_URA").alias("ura_mean"), F.avg("delta_IRI").alias("iri_mean"),
    )
    return per.withColumn("share_of_ptm_intervals", F.col("n") / F.sum("n").over(Window.partitionBy()))


def threshold_sweep(measurements: DataFrame, thresholds: Sequence[float] = SWEEP, corroborated: bool = False) -> DataFrame:
    """Hit rates of reset thresholds with and without treatments; one row per threshold."""
    x = interval_groups(measurements).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit = F.col("delta_URA") <= F.col("threshold")
    if corroborated:
        hit = hit & (F.col("delta_IRI") < 0)
    tp = F.col("has_TP_interval")
    per = x.groupBy("threshold").agg(F.avg(F.when(tp, hit.cast("double"))).alias("tp_rate_proxy"), F.avg(F.when(~tp, hit.cast("double"))).alias("no_tp_rate"), F.count_if(tp & hit).alias("tp_hits"), F.count_if(~tp & hit).alias("no_tp_hits"))
    hits = F.col("tp_hits") + F.col("no_tp_hits")
    return per.withColumns({"precision_proxy": F.when(hits > 0, F.col("tp_hits") / hits), "lift_tp_vs_no_tp": F.when(F.col("no_tp_rate") > 0, F.col("tp_rate_proxy") / F.col("no_tp_rate"))})


def untreated(measurements: DataFrame) -> DataFrame:
    """Intervals without treatment, with bins of gap and previous level."""
    x = interval_groups(measurements).where("not has_TP_interval and Delta_t_years is not null and prev_URA is not null")
    return x.withColumns({"gap_bin": cut_bins(F.col("Delta_t_years"), GAP_EDGES, GAP_LABELS, include_lowest=True), "prev_URA_bin": cut_bins(F.col("prev_URA"), LEVEL_EDGES, LEVEL_LABELS)})


def bin_profile(x: DataFrame, column: str) -> DataFrame:
    d = F.col("delta_URA")
    x = stored(x.where(F.col(column).isNotNull()).select(column, "delta_URA", "delta_IRI"))
    low = quantiles(x, ["delta_URA"], [0.01, 0.05], [column], written=True).select(column, F.col("q")[0].alias("q01_delta_URA"), F.col("q")[1].alias("q05_delta_URA"))
    return x.groupBy(column).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta_URA"),
        share(d <= -3).alias("share_delta_URA_le_minus_3"), share(d <= -5).alias("share_delta_URA_le_minus_5"), F.avg("delta_IRI").alias("mean_delta_IRI"), share(F.col("delta_IRI") < 0).alias("share_delta_IRI_negative"),
    ).join(low, column, "left")


def severe_drops(x: DataFrame, thresholds: Sequence[float] = CORROBORATED) -> DataFrame:
    y = x.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    severe = F.col("delta_URA") <= F.col("threshold")
    per = y.groupBy("threshold").agg(
        F.count_if(severe).alias("n"), share(severe).alias("share_of_no_tp"), F.avg(F.when(severe, (F.col("delta_IRI") < 0).cast("double"))).alias("share_delta_IRI_negative"),
        F.avg(F.when(severe, (F.col("delta_IRI") <= -0.5).cast("double"))).alias("share_delta_IRI_le_minus_0_5"),
    )
    return per.where("n > 0")


def heat_table(x: DataFrame, drop: float = -3.0) -> DataFrame:
    return x.where("gap_bin is not null and prev_URA_bin is not null").groupBy("gap_bin", "prev_URA_bin").agg(F.count("*").alias("n"), share(F.col("delta_URA") <= drop).alias("drop_rate"))


def asset_summary(history: DataFrame) -> DataFrame:
    m, t = F.col("event_type") == "PTM", F.col("event_type") == "TP"
    return history.groupBy("Segment_ID").agg(
        F.count("*").alias("n_events"), F.count_if(m).alias("n_ptm"), F.count_if(t).alias("n_tp"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.countDistinct("Lifecycle_ID").alias("n_lifecycles"), F.min("URA").alias("min_URA"), F.max("URA").alias("max_URA"), F.min("IRI").alias("min_IRI"), F.max("IRI").alias("max_IRI"),
    )


def lifecycle_summary(history: DataFrame) -> DataFrame:
    m = F.col("event_type") == "PTM"
    return history.where("Lifecycle_ID is not null").groupBy("Lifecycle_ID").agg(
        F.min_by("Segment_ID", "Event_Idx").alias("Segment_ID"), F.count("*").alias("n_events"), F.count_if(m).alias("n_ptm"), F.count_if(~m).alias("n_tp"),
        F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.max("Pavement_Age_years").alias("max_age_years"),
    )


def integrity(history: DataFrame) -> DataFrame:
    m, t = F.col("event_type") == "PTM", F.col("event_type") == "TP"
    counts = {
        "rows": F.count("*"), "missing_segment": F.count_if(F.col("Segment_ID").isNull()), "missing_date": F.count_if(F.col("event_date").isNull()), "unknown_type": F.count_if(~m & ~t),
        "ptm_wrong_order": F.count_if(m & (F.col("event_order") != 1)), "tp_wrong_order": F.count_if(t & (F.col("event_order") != 0)), "missing_slot": F.count_if(F.col("slot_idx").isNull()),
        "ptm_missing_URA": F.count_if(m & F.col("URA").isNull()), "ptm_missing_IRI": F.count_if(m & F.col("IRI").isNull()), "tp_missing_surface": F.count_if(t & F.col("Tp_pinta").isNull()),
        "tp_missing_method": F.count_if(t & F.col("Tp_tyomen").isNull()), "ptm_missing_lifecycle": F.count_if(m & F.col("Lifecycle_ID").isNull()),
    }
    return tall(history.agg(*(c.alias(n) for n, c in counts.items())), list(counts))


def knownness(table: DataFrame) -> DataFrame:
    known = lambda c: ~F.coalesce(F.col(c), F.lit("none")).isin("none", "other")
    return table.withColumns({"surface_known": known("tp_surface_type"), "material_known": known("tp_material_type")}).withColumn("both_known", F.col("surface_known") & F.col("material_known"))


def coverage(table: DataFrame) -> DataFrame:
    n = F.coalesce("tp_count_interval", F.lit(0))
    table = stored(table.select("surface_known", "material_known", "both_known", "has_TP_interval", n.alias("n")))
    shares = {
        "surface_known_share": share(F.col("surface_known")), "material_known_share": share(F.col("material_known")), "both_known_share": share(F.col("both_known")),
        "has_TP_interval_share": share(F.col("has_TP_interval")), "mean_tp_count_interval": F.avg("n"),
    }
    median = quantiles(table, ["n"], [0.5], written=True).select(F.lit("median_tp_count_interval").alias("metric"), F.col("q")[0].alias("value"))
    return tall(table.agg(*(c.alias(k) for k, c in shares.items())), list(shares)).unionByName(median)


def coverage_by(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("rows"), share(F.col("surface_known")).alias("surface_known_share"), share(F.col("material_known")).alias("material_known_share"), share(F.col("both_known")).alias("both_known_share"))


def edge_rows(table: DataFrame) -> DataFrame:
    """Rows with a treatment in their interval whose class is none or other."""
    odd = F.col("tp_surface_type").isin("none", "other") | F.col("tp_material_type").isin("none", "other")
    return table.where(F.coalesce(F.col("has_TP_interval"), F.lit(False)) & odd)


def edge_counters(table: DataFrame) -> DataFrame:
    has = F.coalesce(F.col("has_TP_interval"), F.lit(False))
    counts = {
        "tp_but_surface_none": F.count_if(has & (F.col("tp_surface_type") == "none")), "tp_but_material_none": F.count_if(has & (F.col("tp_material_type") == "none")),
        "tp_but_surface_other": F.count_if(has & (F.col("tp_surface_type") == "other")), "tp_but_material_other": F.count_if(has & (F.col("tp_material_type") == "other")),
        "no_tp_but_surface": F.count_if(~has & (F.col("tp_surface_type") != "none")), "no_tp_but_material": F.count_if(~has & (F.col("tp_material_type") != "none")),
    }
    return tall(table.agg(*(c.alias(n) for n, c in counts.items())), list(counts))


def table_summary(table: DataFrame) -> DataFrame:
    table = stored(table.select("Segment_ID", "Lifecycle_ID", "event_date", "target_horizon_days", "target_next_URA"))
    median = quantiles(table, ["target_horizon_days"], [0.5], written=True).select(F.col("q")[0].alias("median_horizon_days"))
    return table.agg(
        F.count("*").alias("rows"), F.countDistinct("Segment_ID").alias("segments"), F.countDistinct("Lifecycle_ID").alias("lifecycles"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.avg("target_horizon_days").alias("mean_horizon_days"), F.count_if(F.col("target_next_URA").isNull()).alias("missing_target"),
    ).join(F.broadcast(median), how="left")


def horizon_coverage(table: DataFrame, horizons: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    parts = [F.struct(F.lit(h).alias("horizon"), F.count(f"target_URA_{h}y").alias("rows"), F.avg(F.col(f"target_URA_{h}y").isNotNull().cast("double")).alias("share"), F.avg(f"actual_horizon_years_{h}y").alias("mean_actual_years")) for h in horizons]
    return table.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def split_diagnostics(table: DataFrame) -> DataFrame:
    return table.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct("Segment_ID").alias("segments"), F.avg("target_horizon_days").alias("mean_horizon"), F.stddev_samp("target_horizon_days").alias("std_horizon"),
        F.avg("target_next_URA").alias("mean_target"), F.stddev_samp("target_next_URA").alias("std_target"), F.min("target_next_URA").alias("min_target"), F.max("target_next_URA").alias("max_target"),
    )


def quantile_grid(df: DataFrame, column: str, percents: Sequence[float] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    return quantiles(df, [column], percents).select(F.explode(F.array_distinct("q")).alias("grid_value"))

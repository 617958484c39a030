"""Errors of predictions: overall, by groups in one pass, calibration, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.functions.columns import quantile_bin
from wearline.operators.prefix import running_sums
from wearline.operators.quantiles import quantile_edges, quantiles
from wearline.sources.tables import stored


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates rows, mae, rmse and r2 (rows without truth or prediction left out)."""
    both = actual.isNotNull() & predicted.isNotNull()
    y, e = F.when(both, actual), F.when(both, actual - predicted)
    n, sse, spread = F.count(e), F.sum(e * e), F.var_pop(y)
    r2 = F.when(n < 2, None).when(spread > 0, 1 - sse / (n * spread)).when(sse == 0, 1.0).otherwise(0.0)
    return {"rows": n, "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": r2}


def metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(*(c.alias(n) for n, c in metric_columns(F.col(actual), F.col(predicted)).items()))


def unpivot_predictors(df: DataFrame, keep: Sequence[str], predictors: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A row per predictor: ``predictors`` maps a label to (target name, actual column, predicted column)."""
    rows = F.array(*(F.struct(F.lit(m.split("/")[0]).alias("model"), F.lit(t).alias("target"), F.col(a).alias("actual"), F.col(p).alias("prediction")) for m, (t, a, p) in predictors.items()))
    return df.select(*keep, F.inline(rows))


def metrics_by_sets(df: DataFrame, always: Sequence[str], groups: Sequence[str], actual: str, predicted: str, least: int = 1, keep_null: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """Metrics overall and by each of ``groups`` in one pass of grouping sets: group_type, group_value and the figures.

    ``least`` rows per group; null groups are kept or left out (they are told from totals by the grouping bits).
    """
    sets = [[*always], *([*always, g] for g in groups)]
    named = {g: f"_g{i}" for i, g in enumerate(groups)}
    wide = df.withColumns({n: F.col(g).cast("string") for g, n in named.items()})
    found = wide.groupingSets(
        [[F.col(c) for c in (named.get(x, x) for x in s)] for s in sets], *always, *named.values()
    ).agg(
        *(c.alias(n) for n, c in metric_columns(F.col(actual), F.col(predicted)).items()),
        *(c.alias(n) for n, c in (more or {}).items()), *(F.grouping(n).alias(f"{n}_off") for n in named.values()),
    )
    kind, value = F.lit("overall"), F.lit("all")
    for g, n in named.items():
        on = F.col(f"{n}_off") == 0
        kind, value = F.when(on, g).otherwise(kind), F.when(on, F.col(n)).otherwise(value)
    out = found.select(*always, kind.alias("group_type"), value.alias("group_value"), "rows", "mae", "rmse", "r2", *(more or {})).where(F.col("rows") >= least)
    return out if keep_null else out.where("group_value is not null")


def calibration(df: DataFrame, actual: str, predicted: str, bins: int = 20) -> DataFrame:
    """Per quantile bin of the prediction: rows and mean of both."""
    df = stored(df.select(F.col(actual), F.col(predicted)))
    edges = quantile_edges(df, predicted, bins, written=True)
    binned = df.join(F.broadcast(edges)).withColumn("bin", quantile_bin(F.col(predicted), F.col("edges")))
    return binned.where("bin is not null").groupBy("bin").agg(
        F.count("*").alias("rows"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae")
    )


def driver_profile(df: DataFrame, driver: str, actual: str, predicted: str, bins: int = 10) -> DataFrame:
    df = stored(df.select(*dict.fromkeys((driver, actual, predicted))))
    edges = quantile_edges(df, driver, bins, written=True)
    binned = stored(df.join(F.broadcast(edges)).withColumn("bin", quantile_bin(F.col(driver), F.col("edges"))).where("bin is not null"))
    medians = quantiles(binned, [driver], [0.5], ["bin"], written=True).select("bin", F.col("q")[0].alias("median_driver"))
    return binned.groupBy("bin").agg(
        F.count("*").alias("rows"), F.avg(driver).alias("mean_driver"),
        F.avg(actual).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"), F.sqrt(F.avg((F.col(actual) - F.col(predicted)) ** 2)).alias("rmse"),
    ).join(medians, "bin")


def errors_by_bin(df: DataFrame, bin_name: str, error: str) -> DataFrame:
    """Per bin: rows, mean and median of the error; rows without a bin are left out."""
    df = stored(df.select(bin_name, error).where(F.col(bin_name).isNotNull()))
    medians = quantiles(df, [error], [0.5], [bin_name], written=True).select(bin_name, F.col("q")[0].alias("median_error"))
    return df.groupBy(bin_name).agg(F.count("*").alias("n"), F.avg(error).alias("mean_error")).join(medians, bin_name, "left")


def error_concentration(df: DataFrame, error: str, key: Sequence[str]) -> DataFrame:
    """Share of rows and of absolute error among the largest errors, per distinct error."""
    per = df.select(F.abs(error).alias("e")).where("e is not null").groupBy("e").agg(F.count("*").alias("n"))
    found = running_sums(per, [], [F.desc("e")], {"rows": F.col("n"), "sum": F.col("n") * F.col("e")})
    return found.select(
        F.col("e").alias("abs_error"), (F.col("rows") / F.col("total_rows")).alias("row_share"), F.when(F.col("total_sum") > 0, F.col("sum") / F.col("total_sum")).alias("error_share"),
    )


def with_gain(results: DataFrame, baseline: DataFrame, on: Sequence[str], measure: str = "rmse") -> DataFrame:
    """Adds the baseline's figure and the gain over it, absolute and in percent."""
    base = baseline.select(*on, F.col(measure).alias(f"persistence_{measure}"))
    gain = F.col(f"persistence_{measure}") - F.col(measure)
    return results.join(base, list(on)).withColumns({"gain": gain, "gain_pct": F.when(F.col(f"persistence_{measure}") > 0, gain / F.col(f"persistence_{measure}") * 100)})


def best_per_group(results: DataFrame, group: Sequence[str], measure: str, ties: Sequence[str]) -> DataFrame:
    """The whole row of the smallest figure per group."""
    order = [F.col(measure).asc_nulls_last(), *ties]
    if not group:
        return results.orderBy(*order).limit(1)
    w = Window.partitionBy(*group).orderBy(*order)
    return results.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def leaderboard(results: DataFrame, measure: str, ties: Sequence[str], k: int) -> DataFrame:
    return results.orderBy(measure, *ties).limit(k)

"""Training tables: next measurement of the lifecycle, previews, stacked horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.functions.columns import YEAR_DAYS, derived_features, elapsed_days, trend
from wearline.operators.history import ASSET, is_measurement
from wearline.operators.temporal import interval_classes


def next_targets(measurements: DataFrame) -> DataFrame:
    """Adds the next measurement of the lifecycle, what remains of it and position flags."""
    cycle = Window.partitionBy(ASSET, "Lifecycle_ID")
    w = cycle.orderBy("event_date", "slot_idx")
    ahead = {f"target_next_{n}": F.lead(c).over(w) for n, c in (("URA", "URA"), ("IRI", "IRI"), ("event_date", "event_date"), ("measurement_idx", "Measurement_Idx"))}
    found = measurements.withColumns(ahead)
    days = elapsed_days(F.col("target_next_event_date"), F.col("event_date"))
    return found.withColumns({
        "target_horizon_days": days, "target_horizon_years": days / F.lit(YEAR_DAYS),
        "measurements_remaining_in_lifecycle": F.max("Measurement_Idx").over(cycle) - F.col("Measurement_Idx"),
        "is_first_measurement_in_lifecycle": F.col("Measurement_Idx") == 1,
        "has_previous_measurement_in_lifecycle": F.col("Measurement_Idx") > 1,
        "has_next_measurement_in_lifecycle": F.col("target_next_event_date").isNotNull(),
        "baseline_persist_URA": F.col("URA"), "baseline_persist_IRI": F.col("IRI"),
    })


def supervised(history: DataFrame) -> DataFrame:
    """One row per measurement that has a later one in its lifecycle, with the interval's treatment classes."""
    measured = interval_classes(history).where(is_measurement() & F.col("Lifecycle_ID").isNotNull() & F.col("event_date").isNotNull())
    return next_targets(measured).na.drop(subset=["target_next_URA", "target_next_IRI"])


def steps_ahead(measurements: DataFrame, steps: int, column: str = "URA") -> DataFrame:
    """Adds the value ``steps`` measurements ahead of the same asset (not lifecycle)."""
    w = Window.partitionBy(ASSET).orderBy("event_date", "slot_idx")
    return measurements.withColumn(f"{column}_plus_{steps}", F.lead(column, steps).over(w)).withColumn(f"date_plus_{steps}", F.lead("event_date", steps).over(w))


def stack_horizons(table: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Up to one row per horizon with targets, deltas, persistence and trend; rows without targets go."""
    rows = F.array(*(
        F.struct(
            F.lit(h).alias("forecast_horizon_years"), F.col(f"target_IRI_{h}y").alias("target_IRI"), F.col(f"target_URA_{h}y").alias("target_URA"),
            F.col(f"actual_horizon_years_{h}y").alias("actual_horizon_years"),
        )
        for h in horizons
    ))
    with_rates = derived_features(table)
    stacked = with_rates.select("*", F.inline(rows)).where("target_IRI is not null and target_URA is not null")
    h = F.col("forecast_horizon_years")
    return stacked.withColumns({
        "stacked_delta_IRI": F.col("target_IRI") - F.col("IRI"), "stacked_delta_URA": F.col("target_URA") - F.col("URA"),
        "baseline_persist_pred_IRI": F.col("IRI"), "baseline_persist_pred_URA": F.col("URA"),
        "baseline_trend_pred_IRI": trend(F.col("IRI"), F.col("iri_rate"), h), "baseline_trend_pred_URA": trend(F.col("URA"), F.col("ura_rate"), h),
        "event_year": F.year("event_date").cast("long"),
    })



"""From events of assets to a chronology with lifecycles, on one exchange by asset.

Events have one row per measurement or treatment: asset, date, kind, order (treatments before
measurements of a day), slot, the main and second measured value.  Everything is a window over
(asset; date, order, slot) or over the same partitions, so an asset's events are shuffled once and
sorted by Spark; there is no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.functions.columns import YEAR_DAYS, elapsed_days, lifecycle_id, not_negative

ASSET = "Segment_ID"
CHRONOLOGY = ("event_date", "event_order", "slot_idx")
FIRST, NOW, LAST = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def chronology() -> Window:
    return Window.partitionBy(ASSET).orderBy(*CHRONOLOGY)


def backwards() -> Window:
    """The chronology from its end.  What lies ahead is a running frame here; one that ends at the end would be evaluated anew for each row."""
    return Window.partitionBy(ASSET).orderBy(*(F.desc(c) for c in CHRONOLOGY))


def is_measurement() -> Column:
    return F.col("event_type") == "PTM"


def is_treatment() -> Column:
    return F.col("event_type") == "TP"


def measured_only(events: DataFrame) -> DataFrame:
    """Events of assets with a measurement; treatments of the others go, rows without asset or date too."""
    any_measured = F.max(is_measurement()).over(Window.partitionBy(ASSET))
    return events.where(F.col(ASSET).isNotNull() & F.col("event_date").isNotNull()).withColumn("_m", any_measured).where("_m").drop("_m")


def semi_reduced(events: DataFrame) -> DataFrame:
    """The same by a semi-join, for events that are not partitioned by asset."""
    events = events.where(F.col(ASSET).isNotNull() & F.col("event_date").isNotNull())
    return events.join(events.where(is_measurement()).select(ASSET).distinct(), ASSET, "left_semi")


def interval_counts(events: DataFrame, name: str = "tp_count_interval") -> DataFrame:
    """Adds, to measurements, the number of treatments in (previous measurement, this one]; the first has no lower end.

    A running count of treatments minus its value at the previous measurement.
    """
    w = chronology()
    counted = events.withColumn("_n", F.count_if(is_treatment()).over(w.rowsBetween(FIRST, NOW)))
    before = F.last(F.when(is_measurement(), F.col("_n")), ignorenulls=True).over(w.rowsBetween(FIRST, -1))
    return counted.withColumn(name, F.when(is_measurement(), F.col("_n") - F.coalesce(before, F.lit(0)))).drop("_n")


def neighbours(events: DataFrame) -> DataFrame:
    """Adds, to measurements, previous and next measurement and what changed since."""
    w = chronology()
    own = F.struct("event_date", "URA", "IRI")
    before = F.last(F.when(is_measurement(), own), ignorenulls=True).over(w.rowsBetween(FIRST, -1))
    after = F.last(F.when(is_measurement(), F.col("event_date")), ignorenulls=True).over(backwards().rowsBetween(FIRST, -1))
    found = events.withColumn("_b", F.when(is_measurement(), before)).withColumn("next_meas_date", F.when(is_measurement(), after))
    found = found.withColumns({"prev_meas_date": F.col("_b.event_date"), "prev_URA": F.col("_b.URA"), "prev_IRI": F.col("_b.IRI")}).drop("_b")
    days = elapsed_days(F.col("event_date"), F.col("prev_meas_date"))
    return found.withColumns({
        "delta_URA": F.col("URA") - F.col("prev_URA"), "delta_IRI": F.col("IRI") - F.col("prev_IRI"),
        "Delta_t_days": days, "Delta_t_years": days / F.lit(YEAR_DAYS), "days_since_prev_meas": days,
        "days_until_next_meas": elapsed_days(F.col("next_meas_date"), F.col("event_date")),
    })


def resets(events: DataFrame, treated_drop: float = -1.0, untreated_drop: float = -3.0) -> DataFrame:
    """Adds has_TP_interval and the reset flags to measurements; a missing change is no reset."""
    has = F.col("tp_count_interval") > 0
    drop = F.col("delta_URA")
    phantom = F.coalesce(~has & (drop <= untreated_drop), F.lit(False))
    major = F.coalesce(has & (drop <= treated_drop), F.lit(False)) | phantom
    return events.withColumns({
        "has_TP_interval": F.when(is_measurement(), has),
        "is_major_reset": F.when(is_measurement(), major),
        "is_phantom_reset": F.when(is_measurement(), phantom),
        "is_minor_treatment": F.when(is_measurement(), has & ~major),
    })


def lifecycles(events: DataFrame) -> DataFrame:
    """Adds cycle number, position, first value, start, age and minor treatments so far to measurements."""
    w = chronology()
    cycles = events.withColumn("_c", F.coalesce(F.sum(F.col("is_major_reset").cast("long")).over(w.rowsBetween(FIRST, NOW)), F.lit(0)))
    whole = Window.partitionBy(ASSET, "_c")
    inner = whole.orderBy(*CHRONOLOGY)
    upto = inner.rowsBetween(FIRST, NOW)
    m = is_measurement()
    start = F.min(F.when(m, F.col("event_date"))).over(whole)
    return cycles.withColumns({
        "_start": F.when(m, start),
        "Measurement_Idx": F.when(m, F.count_if(m).over(upto)),
        "Initial_URA": F.when(m, F.first(F.when(m, F.col("URA")), ignorenulls=True).over(inner.rowsBetween(FIRST, LAST))),
        "Minor_TP_Count": F.when(m, F.sum(F.col("is_minor_treatment").cast("long")).over(upto)),
        "cycle_num": F.when(m, F.col("_c")),
    }).drop("_c").withColumn("Pavement_Age_years", F.when(m, not_negative(elapsed_days(F.col("event_date"), F.col("_start")) / F.lit(YEAR_DAYS))))


def treatment_context(events: DataFrame) -> DataFrame:
    """Fills treatments from the measurements around them: the last at or before and the first at or after their date.

    A measurement of the same day is both.  Frames are by date alone, so it is in both of them.
    """
    day = Window.partitionBy(ASSET).orderBy("event_date")
    from_end = Window.partitionBy(ASSET).orderBy(F.desc("event_date"))
    m = is_measurement()
    own = F.struct("event_date", "slot_idx", "cycle_num", "Initial_URA", "_start")
    before = F.max(F.when(m, own)).over(day.rangeBetween(FIRST, NOW))
    after = F.min(F.when(m, F.struct("event_date", "slot_idx"))).over(from_end.rangeBetween(FIRST, NOW))
    found = events.withColumns({"_b": before, "_a": after})
    date = F.col("event_date")

    def either(measured: Column, treated: Column) -> Column:
        return F.when(m, measured).otherwise(treated)

    c = F.col
    return found.withColumns({
        "prev_meas_date": either(c("prev_meas_date"), c("_b.event_date")),
        "next_meas_date": either(c("next_meas_date"), c("_a.event_date")),
        "days_since_prev_meas": either(c("days_since_prev_meas"), elapsed_days(date, c("_b.event_date"))),
        "days_until_next_meas": either(c("days_until_next_meas"), elapsed_days(c("_a.event_date"), date)),
        "cycle_num": either(c("cycle_num"), c("_b.cycle_num")),
        "Initial_URA": either(c("Initial_URA"), c("_b.Initial_URA")),
        "Pavement_Age_years": either(c("Pavement_Age_years"), not_negative(elapsed_days(date, c("_b._start")) / F.lit(YEAR_DAYS))),
    }).drop("_a", "_b", "_start")


def event_history(events: DataFrame, treated_drop: float = -1.0, untreated_drop: float = -3.0) -> DataFrame:
    """The full chronology of events with lifecycles and context, numbered by Event_Idx."""
    found = lifecycles(resets(neighbours(interval_counts(measured_only(events))), treated_drop, untreated_drop))
    found = treatment_context(found)
    order = Window.partitionBy(ASSET).orderBy(*(F.col(c).asc_nulls_last() for c in CHRONOLOGY))
    return found.withColumns({
        "Lifecycle_ID": F.when(F.col("cycle_num").isNotNull(), lifecycle_id(F.col(ASSET), F.col("cycle_num"))),
        "year": F.year("event_date").cast("long"),
        "Event_Idx": F.row_number().over(order).cast("long"),
    })

"""Joins in time as windows over one chronology per asset: as-of, latest in an interval, nearest within a tolerance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from wearline.functions.columns import MATERIAL_CLASSES, SURFACE_CLASSES, YEAR_MICROS, classify, elapsed_years, micros
from wearline.operators.history import ASSET, FIRST, NOW, chronology, is_measurement, is_treatment


def latest_treatment(history: DataFrame) -> DataFrame:
    """Adds to every row the last treatment at or before it: date, slot, surface and method (struct ``_t``)."""
    own = F.struct("event_date", "slot_idx", "Tp_pinta", "Tp_tyomen")
    return history.withColumn("_t", F.last(F.when(is_treatment(), own), ignorenulls=True).over(chronology().rowsBetween(FIRST, NOW)))


def interval_classes(history: DataFrame) -> DataFrame:
    """Adds tp_surface_type and tp_material_type: classes of the latest treatment in (previous measurement, this one], else ``none``."""
    found = latest_treatment(history)
    inside = F.col("_t").isNotNull() & (F.col("prev_meas_date").isNull() | (F.col("_t.event_date") > F.col("prev_meas_date")))
    return found.withColumns({
        "tp_surface_type": F.when(is_measurement(), F.when(inside, classify(F.col("_t.Tp_pinta"), SURFACE_CLASSES, "none")).otherwise("none")),
        "tp_material_type": F.when(is_measurement(), F.when(inside, classify(F.col("_t.Tp_tyomen"), MATERIAL_CLASSES, "none")).otherwise("none")),
    }).drop("_t")


def current_material(history: DataFrame) -> DataFrame:
    """Adds the state carried forward from the last treatment at or before each row; ``unknown`` without one."""
    found = latest_treatment(history)
    return found.withColumns({
        "latest_material_event_date": F.col("_t.event_date"),
        "surface_type_current": classify(F.col("_t.Tp_pinta"), SURFACE_CLASSES, "unknown"),
        "material_type_current": classify(F.col("_t.Tp_tyomen"), MATERIAL_CLASSES, "unknown"),
        "years_since_material_update": elapsed_years(F.col("event_date"), F.col("_t.event_date")),
    }).drop("_t")


def _sweep(group: np.ndarray, us: np.ndarray, valid: np.ndarray, shift: int, tolerance: int, own: slice) -> np.ndarray:
    """For the rows ``own``, the number of the row of their group nearest to their time + shift (-1: none within the tolerance).

    Rows are in order of group and time; of equal distances the earlier time counts, of equal times the last row
    before the wanted time and the first one after it.
    """
    times = np.unique(us)
    keys = group << 32 | np.searchsorted(times, us)
    want = us[own] + shift
    after = np.searchsorted(keys, group[own] << 32 | np.searchsorted(times, want))
    before = after - 1
    far = np.int64(tolerance + 1)

    def distance(at: np.ndarray) -> np.ndarray:
        inside = np.clip(at, 0, len(us) - 1)
        fits = (at >= 0) & (at < len(us)) & (group[inside] == group[own]) & valid[inside] & valid[own]
        return np.where(fits, np.abs(want - us[inside]), far)

    left, right = distance(before), distance(after)
    return np.where(np.minimum(left, right) > tolerance, -1, np.where(left <= right, before, after))


def nearest(table: DataFrame, by: Sequence[str], date: str, order: str, values: Sequence[str], shifts: dict[str, float], tolerance_years: float = 0.25) -> DataFrame:
    """Adds, for each named shift in years, the row of the same group nearest to date + shift within the tolerance, as a struct (us, values).

    One pass over rows sorted by (group, date, order): the exchange and the sort are those of a window over them, which numbers
    the rows of a group; an Arrow stage follows the sorted rows and finds all shifts by binary search.  It holds the rows within the
    reach of all shifts around those not answered yet, so a long group is never held whole.  Of equal distances the earlier date
    counts; a row without a date has no neighbours; an empty table gives an empty result.
    """
    shift = {n: round(y * YEAR_MICROS) for n, y in shifts.items()}
    tolerance = round(tolerance_years * YEAR_MICROS)
    ahead, back = max(0, *shift.values()) + tolerance, max(0, *(-v for v in shift.values())) + tolerance
    w = Window.partitionBy(*by).orderBy(date, order)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    entry = StructType([StructField("us", LongType()), *(StructField(v, kinds[v]) for v in values)])
    sorted_rows = table.withColumns({"_us": micros(F.col(date)), "_row": F.row_number().over(w)})
    n = len(table.columns)
    names = [*table.columns, *shift]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = 0  # rows of ``held`` that are answered and kept for those behind them
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = pa.Table.from_batches([batch])
                held = own if held is None else pa.concat_tables([held, own])
            if held is None or not len(held):
                continue
            us = held.column(n).fill_null(-(1 << 62)).to_numpy()
            valid = ~held.column(n).is_null().to_numpy(zero_copy_only=False)
            group = np.cumsum(held.column(n + 1).to_numpy() == 1)
            ready = len(held) if batch is None else int(np.searchsorted(group << 1 | (us + ahead >= us[-1]), group[-1] << 1 | 1))
            if ready > done:
                out = held.slice(done, ready - done).combine_chunks()
                columns = [c.combine_chunks() for c in out.columns[:n]]
                for s in shift.values():
                    at = _sweep(group, us, valid, s, tolerance, slice(done, ready))
                    pick = pa.array(at, mask=at < 0)
                    parts = [held.column(n).take(pick).combine_chunks(), *(held.column(v).take(pick).combine_chunks() for v in values)]
                    columns.append(pa.StructArray.from_arrays([_flat(x) for x in parts], fields=[pa.field("us", pa.int64()), *(held.schema.field(v) for v in values)], mask=pa.array(at < 0)))
                yield from pa.Table.from_arrays([_flat(c) for c in columns], names).to_batches()
                done = ready
            first = us[done] - back if done < len(held) else 0
            keep = int(np.searchsorted(group << 1 | (us >= first), group[done] << 1 | 1)) if done < len(held) else len(held)
            held, done = held.slice(keep), done - keep

    return sorted_rows.mapInArrow(follow, StructType([*table.schema.fields, *(StructField(name, entry) for name in shift)]))


def _flat(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def fixed_horizons(table: DataFrame, back: tuple[int, ...] = (1, 2, 3), ahead: tuple[int, ...] = (1, 2, 3, 4), tolerance_years: float = 0.25) -> DataFrame:
    """Adds values nearest to k years before and h years after each row of the same lifecycle."""
    shifts = {**{f"_b{k}": -k for k in back}, **{f"_a{h}": h for h in ahead}}
    found = nearest(table, [ASSET, "Lifecycle_ID"], "event_date", "Measurement_Idx", ["IRI", "URA"], shifts, tolerance_years)
    us, year = micros(F.col("event_date")), F.lit(float(YEAR_MICROS))
    columns: dict[str, Column] = {}
    for k in back:
        columns |= {f"IRI_hist_{k}y": F.col(f"_b{k}.IRI"), f"URA_hist_{k}y": F.col(f"_b{k}.URA"), f"history_gap_years_{k}y": (us - F.col(f"_b{k}.us")) / year}
    for h in ahead:
        columns |= {f"target_IRI_{h}y": F.col(f"_a{h}.IRI"), f"target_URA_{h}y": F.col(f"_a{h}.URA"), f"actual_horizon_years_{h}y": (F.col(f"_a{h}.us") - us) / year}
    return found.withColumns(columns).drop(*shifts)

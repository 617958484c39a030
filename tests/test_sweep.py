"""Nearest in time by one sweep, against brute force, for batches of any size."""

import datetime as dt
import random

import pytest

from wearline.functions.columns import YEAR_MICROS
from wearline.operators import temporal

SHIFTS = {"back": -1.0, "ahead": 2.0, "same": 0.0}
KIND = "g string, d timestamp_ntz, i int, v double"
EPOCH = dt.datetime(1970, 1, 1)


def micros(d):
    return (d - EPOCH) // dt.timedelta(microseconds=1)


def brute(rows, tolerance=0.25):
    out = {}
    limit = round(tolerance * YEAR_MICROS)
    for g, d, i, _ in rows:
        for name, years in SHIFTS.items():
            best = None
            if d is not None:
                want = micros(d) + round(years * YEAR_MICROS)
                for h, e, j, v in rows:
                    if h == g and e is not None and abs(micros(e) - want) <= limit:
                        t = micros(e)
                        key = (abs(t - want), t, -j if t < want else j)
                        best = min(best, (key, (t, v))) if best else (key, (t, v))
            out[g, i, name] = best and best[1]
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    found = []
    for g in ("a", "b", "c", "d"):
        days = [rnd.randrange(0, 2500) for _ in range(1 if g == "c" else 60)]
        days += days[:7]  # ties
        found += [(g, EPOCH + dt.timedelta(days=x), i, None if i % 9 == 0 else float(i)) for i, x in enumerate(sorted(days))]
    # exact distances on both sides, and rows without a date
    year = dt.timedelta(microseconds=YEAR_MICROS)
    found += [("e", EPOCH, 0, 0.0), ("e", EPOCH + 2 * year - year / 4, 1, 1.0), ("e", EPOCH + 2 * year + year / 4, 2, 2.0), ("e", None, 3, 3.0), ("e", None, 4, 4.0)]
    return found


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_nearest_equals_brute_force(spark, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, KIND).repartition(5)
        got = temporal.nearest(df, ["g"], "d", "i", ["v"], SHIFTS).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    want = brute(rows)
    assert {(r["g"], r["i"], n): r[n] and tuple(r[n]) for r in got for n in SHIFTS} == want


def test_no_rows(spark, rows):
    df = spark.createDataFrame(rows, KIND).where("g = 'none'")
    assert temporal.nearest(df, ["g"], "d", "i", ["v"], SHIFTS).collect() == []


def test_one_exchange_and_no_sliding_frame(spark, rows):
    df = temporal.nearest(spark.createDataFrame(rows, KIND), ["g"], "d", "i", ["v"], SHIFTS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "RangeFrame" not in plan

"""Exact quantiles and running sums against plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import prefix, quantiles
from wearline.operators.audit import ecdf
from wearline.operators.splits import stratified_assets

PERCENTS = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.995, 1.0)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(0)
    found = []
    for i in range(4000):
        g = None if i % 5 == 0 else "ab"[i % 2]
        wide = rnd.choice((-1, 1)) * math.exp(rnd.uniform(-300, 300))
        near = 1.0 + i * 2.0**-52
        found.append((g, rnd.gauss(0, 1), float(rnd.randrange(5)), wide, near, None if i % 3 else float(i), None))
    return found


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, few double, wide double, near double, holes double, none double").repartition(7)


def plain(values):
    return [np.quantile(np.sort([v for v in values if v is not None]), p) for p in PERCENTS]


@pytest.mark.parametrize("parts", [quantiles.PARTS, 16])  # 16: many passes, no range is small
def test_all_columns_at_once(table, rows, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    columns = ["x", "few", "wide", "near", "holes", "none"]
    got = {r["column_name"]: r["q"] for r in quantiles.quantiles(table, columns, PERCENTS).collect()}
    assert set(got) == set(columns) - {"none"}
    for k, c in enumerate(columns[:-1], 1):
        assert got[c] == pytest.approx(plain([r[k] for r in rows]), rel=1e-12)


def test_by_group(table, rows):
    got = {r["g"]: r["q"] for r in quantiles.quantiles(table, ["x"], PERCENTS, ["g"]).collect()}
    assert set(got) == {None, "a", "b"}
    for g in got:
        assert got[g] == pytest.approx(plain([r[1] for r in rows if r[0] == g]), rel=1e-12)


def test_single_values_infinities_and_no_rows(spark):
    one = spark.createDataFrame([(3.5,)], "x double")
    assert quantiles.quantiles(one, ["x"], PERCENTS).first()["q"] == [3.5] * len(PERCENTS)
    assert quantiles.quantiles(one.where("x > 4"), ["x"], PERCENTS).count() == 0
    inf = float("inf")
    odd = spark.createDataFrame([(inf,), (-inf,), (0.0,), (-0.0,), (float("nan"),)], "x double")
    low, zero, top, last = quantiles.quantiles(odd, ["x"], (0.0, 0.25, 0.75, 1.0)).first()["q"]
    assert (low, zero, top) == (-inf, 0.0, inf) and math.isnan(last)


def test_no_percentile_buffer(table):
    plan = quantiles.quantiles(table, ["x", "near"], PERCENTS)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_running_sums(table, rows):
    got = prefix.running_sums(table.select("g", "x", "few"), ["g"], ["x"], {"s": F.col("few"), "n": F.lit(1).cast("long")}).collect()
    for g in (None, "a", "b"):
        own = sorted((r[1], r[2]) for r in rows if r[0] == g)
        mine = sorted((r["x"], r["s"], r["n"], r["total_s"], r["total_n"]) for r in got if r["g"] == g)
        assert [m[1] for m in mine] == list(np.cumsum([v for _, v in own])) and [m[2] for m in mine] == list(range(1, len(own) + 1))
        assert {m[3:] for m in mine} == {(sum(v for _, v in own), len(own))}
    assert prefix.ranked(table.where("x > 99"), ["g"], ["x"]).count() == 0


def test_ecdf_of_one_group_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") % 500).alias("v"))
        got = {r["v"]: r["cdf"] for r in ecdf(df, "v", ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {v: (v + 1) / 500 for v in range(500)}


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 1)), (2, (0, 1, 1)), (3, (1, 1, 1)), (4, (2, 1, 1)), (20, (14, 3, 3))])
def test_small_strata(spark, n, want):
    df = spark.createDataFrame([(f"s{i}", "north") for i in range(n)] * 2, "Segment_ID string, ELY string")
    got = [r["split"] for r in stratified_assets(df, "Segment_ID", "ELY").collect()]
    assert tuple(got.count(s) for s in ("train", "validation", "test")) == want

"""The hand-computed case of one asset, and edge cases of the history operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wearline.functions import columns as col
from wearline.operators import audit, history, metrics, reshape, splits, supervised, temporal

SCHEMA = "Segment_ID string, event_type string, event_order int, slot_idx int, event_date timestamp_ntz, IRI double, URA double, Tp_pinta string, Tp_tyomen string"


def day(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def golden(spark):
    rows = [
        ("S", "PTM", 1, 1, day("2006-06-01"), 1.0, 4.0, None, None), ("S", "PTM", 1, 2, day("2008-06-01"), 1.2, 6.0, None, None),
        ("S", "PTM", 1, 3, day("2010-06-01"), 1.0, 4.5, None, None), ("S", "PTM", 1, 4, day("2012-06-01"), 1.1, 1.0, None, None),
        ("S", "TP", 0, 1, day("2005-05-01"), None, None, "ab", "lta"), ("S", "TP", 0, 2, day("2010-06-01"), None, None, "SMA", "rem"),
        ("T", "TP", 0, 1, day("2010-06-01"), None, None, "SMA", "rem"), (None, "PTM", 1, 1, day("2010-06-01"), 1.0, 1.0, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_golden_history(golden):
    rows = history.event_history(golden).orderBy("Event_Idx").collect()
    assert [r["event_type"] for r in rows] == ["TP", "PTM", "PTM", "TP", "PTM", "PTM"]
    assert [r["tp_count_interval"] for r in rows] == [None, 1, 0, None, 1, 0]
    assert [r["delta_URA"] for r in rows] == [None, None, 2.0, None, -1.5, -3.5]
    assert [r["Delta_t_days"] for r in rows] == [None, None, 731, None, 730, 731]
    assert [r["days_until_next_meas"] for r in rows] == [396, 731, 730, 0, 731, None]
    assert [r["is_major_reset"] for r in rows] == [None, False, False, None, True, True]
    assert [r["is_phantom_reset"] for r in rows] == [None, False, False, None, False, True]
    assert [r["is_minor_treatment"] for r in rows] == [None, True, False, None, False, False]
    assert [r["cycle_num"] for r in rows] == [None, 0, 0, 1, 1, 2]
    assert [r["Measurement_Idx"] for r in rows] == [None, 1, 2, None, 1, 1]
    assert [r["Initial_URA"] for r in rows] == [None, 4.0, 4.0, 4.5, 4.5, 1.0]
    assert [r["Minor_TP_Count"] for r in rows] == [None, 1, 1, None, 0, 0]
    assert [r["Pavement_Age_years"] for r in rows] == [None, 0, pytest.approx(731 / 365.25), 0, 0, 0]


def test_golden_supervised(golden):
    (row,) = supervised.supervised(history.event_history(golden)).collect()
    assert (row["target_next_URA"], row["target_next_IRI"], row["target_horizon_days"]) == (6.0, 1.2, 731)
    assert (row["measurements_remaining_in_lifecycle"], row["tp_surface_type"], row["tp_material_type"]) == (1, "AB", "new")


def test_one_exchange_for_the_chain(golden, tmp_path, spark):
    golden.write.parquet(str(tmp_path / "events"))
    plan = history.event_history(spark.read.parquet(str(tmp_path / "events")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan


def test_same_day_measurements_and_current_state(spark):
    rows = [("A", "PTM", 1, 1, day("2006-01-01"), 1.0, 5.0, None, None), ("A", "PTM", 1, 2, day("2006-01-01"), 1.0, 6.0, None, None), ("A", "TP", 0, 1, day("2006-01-01"), None, None, " ", "zzz")]
    found = history.event_history(spark.createDataFrame(rows, SCHEMA)).orderBy("Event_Idx").collect()
    assert [r["tp_count_interval"] for r in found] == [None, 1, 0]
    state = temporal.current_material(history.event_history(spark.createDataFrame(rows, SCHEMA))).orderBy("Event_Idx").collect()
    assert [(r["surface_type_current"], r["material_type_current"]) for r in state] == [("unknown", "other")] * 3


def test_coercion(spark):
    rows = spark.createDataFrame([("1,5",), ("x",), (None,), (" 2.5 ",), ("NaN",)], "a string")
    assert [r[0] for r in rows.select(col.to_number(F.col("a"))).collect()] == [1.5, None, None, 2.5, None]
    dates = spark.createDataFrame([("2006-01-02",), ("none",), (None,)], "a string").select(col.to_date(F.col("a"))).collect()
    assert [r[0] for r in dates] == [day("2006-01-02"), None, None]


def test_wide_rows(spark):
    wide = spark.createDataFrame(
        [("S", "100,0", "2006-01-01", "1,5", "4", "1900-01-01", "ab", "lta"), ("L", "90", "2006-01-01", "1", "4", None, None, None), ("B", "100", "2006-01-01", "1", "80.1", None, None, None), ("C", "100", "2006-01-01", "1", "40.5", None, None, None)],
        "Segment_ID string, Pituus string, PTM_pvm_1 string, Iri_1 string, Ura_max_1 string, Tp_pvm_1 string, Tp_pinta_1 string, `Tp_työmen_1` string",
    )
    assert [(r["Segment_ID"], r["IRI"], r["URA"]) for r in reshape.measurements_long(wide, ["Segment_ID"]).collect()] == [("S", 1.5, 4.0)]
    assert reshape.treatments_long(wide, ["Segment_ID"]).count() == 0


def test_nearest_prefers_the_earlier_of_equals(spark):
    year = 31557600
    base = datetime(2000, 1, 1)
    from datetime import timedelta

    rows = [("A", "c", i, base + timedelta(seconds=s), float(i), float(i)) for i, s in enumerate([0, year - 1000, year + 1000, 3 * year])]
    df = spark.createDataFrame(rows, "Segment_ID string, Lifecycle_ID string, Measurement_Idx int, event_date timestamp_ntz, IRI double, URA double")
    found = {r["Measurement_Idx"]: r["target_URA_1y"] for r in temporal.fixed_horizons(df).collect()}
    assert found == {0: 1.0, 1: None, 2: None, 3: None}


@pytest.mark.parametrize("n,expected", [(1, {"test": 1}), (2, {"validation": 1, "test": 1}), (3, {"train": 1, "validation": 1, "test": 1}), (20, {"train": 14, "validation": 3, "test": 3})])
def test_small_strata(spark, n, expected):
    df = spark.createDataFrame([(str(i), "e") for i in range(n)], "Segment_ID string, ELY string")
    found = splits.stratified_assets(df, "Segment_ID", "ELY").groupBy("split").count().collect()
    assert sum(r["count"] for r in found) == n
    if n >= 3:
        assert {r["split"]: r["count"] for r in found} == expected


def test_metrics_of_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 1.0)], "y double, p double")
    row = metrics.metrics(df, "y", "p").first()
    assert (row["rows"], row["mae"], row["r2"]) == (2, 0.5, 0.0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = history.event_history(empty)
    assert found.count() == 0 and supervised.supervised(found).count() == 0
    assert audit.integrity(found).where("metric = 'rows'").first()["value"] == 0


def test_frames_run_forward(spark):
    """No frame from the current row to the end, which would be evaluated anew for each row of an asset."""
    import io
    from contextlib import redirect_stdout

    from wearline import fixtures as fx

    out = io.StringIO()
    with redirect_stdout(out):
        fx.history(spark, "/root/testdata/sf0.001").explain("extended")
    frames = [x for x in out.getvalue().split("specifiedwindowframe(")[1:]]
    assert frames and not any("unboundedfollowing" in f.split("))")[0] and "unboundedpreceding" not in f.split("))")[0] for f in frames)


def test_history_from_buckets_has_no_exchange(spark):
    from wearline.plans.model_queries import _bucketed_events
    from wearline.operators.history import event_history

    events = _bucketed_events(spark, "/root/testdata/sf0.001")
    whole = event_history(events)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in whole and "Window" in whole
    one = event_history(events.where("Segment_ID = '7'"))._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in one and "Exchange" not in one


def test_tasks_of_the_chain_grow_with_the_lines(spark, monkeypatch):
    """A task's sorts hold about TASK_ROWS lines at any size, so the number of tasks follows the input and not the cores."""
    from wearline import fixtures as fx
    from wearline.plans.model_queries import _bucketed_events

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(fx, "TASK_ROWS", 500)
    wanted = -(-fx.view(spark, data, "lineitem").count() // 500)
    assert wanted > 8
    found = fx.training(spark, data).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(found) == wanted and max(r["count"] for r in found) <= 1000
    assert history.event_history(_bucketed_events(spark, data)).rdd.getNumPartitions() == wanted


def test_tasks_of_the_split_grow_with_the_lines(spark, monkeypatch):
    """The join of the wide training rows with their assets' splits has as many tasks as the chain, each with about as many rows."""
    from wearline import fixtures as fx
    from wearline.plans.model_queries import _split

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(fx, "TASK_ROWS", 200)
    train, valid, test = _split(spark, data)
    table = train.unionByName(valid).unionByName(test)
    assert table.count() == fx.training(spark, data).count()
    per_file = table.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 0.8 * fx.parts(spark, data) > 20 and max(r["count"] for r in per_file) <= 400


def test_column_order():
    from wearline.functions.columns import ordered

    class Frame:
        columns = ["b", "a", "c"]

        def select(self, *names):
            return names

    assert ordered(Frame(), ["c", "none", "a"]) == ("c", "a", "b")

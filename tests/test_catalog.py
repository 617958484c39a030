"""Every query with SQL gives DuckDB's result on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wearline.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return round(float(value), 5)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql is not None])
def test_same_as_sql(spark, duck, name):
    run, sql = CATALOG[name]
    df = run(spark, DATA)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_column_order_returns_the_rows(spark, duck):
    """All rows of the training table in the preferred order of columns, not counts of them."""
    found = CATALOG["prj_15_column_order"][0](spark, DATA)
    assert found.columns == ["Segment_ID", "event_date", "URA", "IRI", "slot_idx"]
    assert found.count() == CATALOG["win_09_10_flt_06_supervised"][0](spark, DATA).count() > 1000


def test_chain_is_read_once(spark):
    """Both errors of the gain, and all bands, come from one pass over the history chain."""
    gain, bands = (CATALOG[n][0](spark, DATA)._jdf.queryExecution().executedPlan().toString() for n in ("joi_09_agg_11_gain", "flt_08_horizon_bands"))
    assert "Window" not in gain and "Union" not in bands and "Window" in bands


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

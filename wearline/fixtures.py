"""The test tables as event histories: parts of ``lineitem`` as assets, and users of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.history import ASSET, event_history
from wearline.operators.supervised import supervised
from wearline.operators.temporal import fixed_horizons

#: Valid in Spark SQL and in DuckDB: returned lines are treatments, other lines measurements.
EVENTS_SQL = """
SELECT CAST(l.l_partkey AS STRING) AS Segment_ID, p.p_type AS ELY, p.p_brand AS Toim_lk,
       CAST(p.p_size AS DOUBLE) AS KVL, CAST(p.p_size % 7 AS DOUBLE) AS KVL_raskas, CAST(p.p_size % 5 AS DOUBLE) AS KVL_kaista,
       CAST(40 + 20 * (p.p_size % 4) AS DOUBLE) AS Nopeus, l.l_shipdate AS event_date,
       CASE WHEN l.l_returnflag = 'R' THEN 'TP' ELSE 'PTM' END AS event_type,
       CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END AS event_order,
       row_number() OVER (PARTITION BY l.l_partkey, CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END
                          ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber) AS slot_idx,
       CASE WHEN l.l_returnflag <> 'R' THEN l.l_quantity END AS URA,
       CASE WHEN l.l_returnflag <> 'R' THEN l.l_tax * 100 END AS IRI,
       CASE WHEN l.l_returnflag = 'R' THEN
            CASE l.l_linenumber % 5 WHEN 0 THEN 'ab' WHEN 1 THEN 'PAB-V' WHEN 2 THEN ' sma ' WHEN 3 THEN 'xyz' END END AS Tp_pinta,
       CASE WHEN l.l_returnflag = 'R' THEN
            CASE l.l_suppkey % 4 WHEN 0 THEN 'lta' WHEN 1 THEN 'REM' WHEN 2 THEN 'foo' END END AS Tp_tyomen
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""
VALID = "event_type = 'TP' OR (URA <= 40 AND IRI <= 10)"
#: Quantities vary far more than rutting does, so the reset thresholds are scaled.
TREATED_DROP, UNTREATED_DROP = -20.0, -30.0
#: Lines of one task of the history chain, which sorts them in several orders; its memory stays the same at any size.
TASK_ROWS = 50_000
#: Days to the next measurement are shorter here.
WINDOWS = (("short", 0, 60), ("middle", 61, 180), ("long", 181, 400))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the chain has, by the number of lines that the files state.

    Left to Spark, there are as many as cores until each reads 64 MB compressed, and every window's sort holds its share.
    """
    return max(1, -(-view(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, before validity rules."""
    tables = {n: view(spark, sf_dir, n) for n in ("lineitem", "part")}
    tables["lineitem"] = tables["lineitem"].repartition(parts(spark, sf_dir), "l_partkey")
    sql = EVENTS_SQL.replace("FROM lineitem l JOIN part p", "FROM {lineitem} l JOIN {part} p")
    return spark.sql(sql, **tables).withColumn("event_date", F.col("event_date").cast("timestamp_ntz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(VALID).repartition(parts(spark, sf_dir), ASSET)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_history(events(spark, sf_dir), TREATED_DROP, UNTREATED_DROP)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where("event_type = 'PTM'")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised(history(spark, sf_dir))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_horizons(training(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with as many indexed slot columns as the data need, as text: dates, decimal commas, placeholders of 1900."""
    raw = raw_events(spark, sf_dir)
    slots = raw.agg(F.max("slot_idx")).first()[0] or 1
    date = F.when(F.col("slot_idx") % 11 == 0, "1900-01-01").when(F.col("slot_idx") % 13 == 0, "none").otherwise(F.date_format("event_date", "yyyy-MM-dd"))
    number = lambda c: F.when(F.col("slot_idx") % 5 == 0, F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))).otherwise(F.col(c).cast("string"))
    picked = raw.select("Segment_ID", "ELY", "KVL", "event_type", "slot_idx", date.alias("date"), number("URA").alias("ura"), number("IRI").alias("iri"), "Tp_pinta", "Tp_tyomen")
    entry = F.struct("date", "iri", "ura", "Tp_pinta", "Tp_tyomen")
    # A map of slots for each kind of event, then one column for each slot.
    slot = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("event_type") == kind, F.struct("slot_idx", entry.alias("v")))))
    maps = picked.groupBy("Segment_ID", "ELY", "KVL").agg(slot("PTM").alias("m"), slot("TP").alias("t"))
    out = []
    for i in range(1, slots + 1):
        out += [F.try_element_at("m", F.lit(i))[c].alias(f"{n}_{i}") for n, c in (("PTM_pvm", "date"), ("Iri", "iri"), ("Ura_max", "ura"))]
        out += [F.try_element_at("t", F.lit(i))[c].alias(f"{n}_{i}") for n, c in (("Tp_pvm", "date"), ("Tp_pinta", "Tp_pinta"), ("Tp_tyomen", "Tp_tyomen"))]
    length = F.when(F.col("KVL") % 10 == 0, 90.0).otherwise(100.0).alias("Pituus")
    return maps.select("Segment_ID", "ELY", "KVL", length, *out)

"""Queries over the test tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import fixtures as fx
from wearline.functions import columns as col
from wearline.operators import audit, history, metrics, reshape, splits, supervised, temporal
from wearline.plans.oracle_views import EV, FH, HIST, LATEST, MATERIAL, P0, P1, P2, RAW, SEG, SUP, SURFACE, days
from wearline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return col.rounded(f(spark, sf_dir))

        CATALOG[name] = (run, sql)
        return f

    return put


def r(*names: str) -> str:
    """Rounded columns of the same names."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def rx(**named: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in named.items())


# Sources and scalar functions ------------------------------------------------------------------------------------


@query("src_02_event_type_scan", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def _(s, d):
    return tables.scan_events(s, f"{d}/events.parquet", ["event_id", "user_id", "value"], "purchase")


@query("src_03_dated_scan", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders")
def _(s, d):
    return tables.scan_dated(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderdate", "o_orderstatus"], ["o_orderdate"])


_MIXED = "CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderstatus WHEN o_orderkey % 3 = 0 THEN replace(CAST(o_custkey AS VARCHAR) || '.25', '.', ',') ELSE ' ' || CAST(o_custkey AS VARCHAR) || '.5 ' END"


@query("prj_01_number_coercion", f"SELECT o_orderkey, try_cast(replace(trim({_MIXED}), ',', '.') AS DOUBLE) AS x FROM orders")
def _(s, d):
    return fx.view(s, d, "orders").select("o_orderkey", col.to_number(F.expr(_MIXED.replace("VARCHAR", "STRING"))).alias("x"))


_DATED = "CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END"


@query("prj_02_date_coercion", f"SELECT o_orderkey, try_cast({_DATED} AS TIMESTAMP) AS x FROM orders")
def _(s, d):
    return fx.view(s, d, "orders").select("o_orderkey", col.to_date(F.expr(_DATED.replace("VARCHAR", "STRING"))).alias("x"))


@query("prj_03_clamp", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 60 THEN round(value, 6) END AS x FROM events")
def _(s, d):
    return fx.view(s, d, "events").select("event_id", col.clamp(F.col("value"), 10, 60).alias("x"))


@query("prj_04_typed_coercion", "SELECT event_id, try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL AS numeric_ok, CAST(user_id AS BIGINT) AS user_id FROM events")
def _(s, d):
    return fx.view(s, d, "events").select("event_id", col.to_number(F.col("value")).isNotNull().alias("numeric_ok"), F.col("user_id").cast("long"))


@query("prj_05_06_asset_and_lifecycle_id", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CAST(l_partkey AS VARCHAR), 'nan') || '_' || coalesce(CAST(nullif(l_suppkey % 4, 0) AS VARCHAR), 'nan') AS asset, CAST(l_partkey AS VARCHAR) || '_C' || l_linenumber AS cycle FROM lineitem")
def _(s, d):
    x = fx.view(s, d, "lineitem").withColumn("k", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 4))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", col.asset_id(["l_partkey", "k"]).alias("asset"), col.lifecycle_id(F.col("l_partkey").cast("string"), F.col("l_linenumber")).alias("cycle"))


@query("prj_07_08_10_elapsed", f"SELECT event_id, year(ts)::BIGINT AS y, {days('ts', 'p')} AS d, round({days('ts', 'p')} / CAST(365.25 AS DOUBLE), 6) AS yrs FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def _(s, d):
    from pyspark.sql.window import Window

    x = fx.view(s, d, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return x.select("event_id", F.year("ts").cast("long").alias("y"), col.elapsed_days(F.col("ts"), F.col("p")).alias("d"), col.elapsed_years(F.col("ts"), F.col("p")).alias("yrs"))


@query("prj_09_not_negative", "SELECT event_id, round(greatest(value - 50, 0.0), 6) AS x FROM events")
def _(s, d):
    return fx.view(s, d, "events").select("event_id", col.not_negative(F.col("value") - 50).alias("x"))


@query("prj_11_12_13_26_classes", f"WITH {EV} SELECT Segment_ID, slot_idx, {SURFACE.format(c='Tp_pinta', n='none')} AS surface, {MATERIAL.format(c='Tp_tyomen', n='none')} AS material, {SURFACE.format(c='Tp_pinta', n='unknown')} AS state, nullif(lower(trim(Tp_pinta)), '') AS token FROM ev WHERE event_type = 'TP'")
def _(s, d):
    x = fx.events(s, d).where("event_type = 'TP'")
    p, t = F.col("Tp_pinta"), F.col("Tp_tyomen")
    return x.select("Segment_ID", "slot_idx", col.classify(p, col.SURFACE_CLASSES, "none").alias("surface"), col.classify(t, col.MATERIAL_CLASSES, "none").alias("material"), col.classify(p, col.SURFACE_CLASSES, "unknown").alias("state"), col.token(p).alias("token"))


_WIN = "CASE WHEN {c} BETWEEN 0 AND 60 THEN 'short' WHEN {c} BETWEEN 61 AND 180 THEN 'middle' WHEN {c} BETWEEN 181 AND 400 THEN 'long' ELSE 'outside_windows' END"


@query("prj_22_horizon_window", f"WITH {SUP} SELECT Segment_ID, slot_idx, {_WIN.format(c='target_horizon_days')} AS horizon_window FROM sup")
def _(s, d):
    return fx.training(s, d).select("Segment_ID", "slot_idx", col.horizon_window(F.col("target_horizon_days"), fx.WINDOWS).alias("horizon_window"))


@query("prj_16_17_features", f"WITH {SUP} SELECT Segment_ID, slot_idx, {rx(heavy_share='CASE WHEN KVL > 0 THEN KVL_raskas / KVL END', iri_rate='CASE WHEN Delta_t_years > 0 THEN (IRI - prev_IRI) / Delta_t_years END', ura_rate='CASE WHEN Delta_t_years > 0 THEN (URA - prev_URA) / Delta_t_years END', age_x_traffic='Pavement_Age_years * KVL', age_x_heavy='Pavement_Age_years * KVL_raskas')}, coalesce(Toim_lk, 'missing') AS Toim_lk FROM sup")
def _(s, d):
    x = col.derived_features(fx.training(s, d))
    return x.select("Segment_ID", "slot_idx", "heavy_share", "iri_rate", "ura_rate", "age_x_traffic", "age_x_heavy", col.fill_category(F.col("Toim_lk")).alias("Toim_lk"))


@query("prj_19_20_21_29_30_31_residuals", f"WITH {SUP} SELECT Segment_ID, slot_idx, {rx(delta='target_next_URA - URA', rebuilt='URA + (target_next_URA - URA)', residual='target_next_URA - URA', residual_2='URA - target_next_URA', abs_error='abs(target_next_URA - URA)', picked='target_next_IRI', trend_URA='URA + 2 * (CASE WHEN Delta_t_years > 0 THEN (URA - prev_URA) / Delta_t_years END)')}, ELY || ' | ' || Toim_lk AS label FROM sup")
def _(s, d):
    x = col.derived_features(fx.training(s, d))
    a, p = F.col("target_next_URA"), F.col("baseline_persist_URA")
    one, two = col.residuals(a, p, F.col("URA")), col.residuals(a, p, F.col("URA"), "predicted_minus_actual")
    return x.select(
        "Segment_ID", "slot_idx", (a - F.col("URA")).alias("delta"), col.reconstruct(F.lit("delta_URA"), F.col("URA"), a - F.col("URA")).alias("rebuilt"), one["residual"].alias("residual"), two["residual"].alias("residual_2"),
        one["abs_error"].alias("abs_error"), col.pick_by_name(F.lit("IRI"), {"URA": a, "IRI": F.col("target_next_IRI")}).alias("picked"), col.trend(F.col("URA"), F.col("ura_rate"), F.lit(2)).alias("trend_URA"), col.label_of(F.col("ELY"), F.col("Toim_lk")).alias("label"),
    )


@query("prj_28_winsorise", "WITH q AS (SELECT quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events) SELECT event_id, round(least(greatest(value, a), b), 6) AS value_w FROM events, q")
def _(s, d):
    return audit.winsorised(fx.view(s, d, "events"), "value").select("event_id", "value_w")


_PARAMS = "'{\"learning_rate\": ' || CAST(o_custkey % 5 AS VARCHAR) || ', \"leaf\": ' || CAST(o_custkey % 3 AS VARCHAR) || '}'"


_KEY = "'{\"leaf\":' || CAST(o_custkey % 3 AS VARCHAR) || ',\"learning_rate\":' || CAST(CAST(o_custkey % 5 AS DOUBLE) AS VARCHAR) || '}'"


def _candidates(s, d):
    x = fx.view(s, d, "orders").select("o_orderkey", F.from_json(F.expr(_PARAMS.replace("VARCHAR", "STRING")), "learning_rate double, leaf long").alias("p"))
    return x.select("o_orderkey", "p.*", col.parameter_key(F.col("p"), ["leaf", "learning_rate"]).alias("params_key"))


@query("ddp_03_distinct_candidates", f"SELECT DISTINCT CAST(o_custkey % 5 AS DOUBLE) AS learning_rate, CAST(o_custkey % 3 AS BIGINT) AS leaf, {_KEY} AS params_key FROM orders")
def _(s, d):
    """Candidates once by their canonical parameters."""
    return _candidates(s, d).drop("o_orderkey").dropDuplicates(["params_key"])


@query("prj_27_json_parameters", f"SELECT o_orderkey, CAST(o_custkey % 5 AS DOUBLE) AS learning_rate, CAST(o_custkey % 3 AS BIGINT) AS leaf, {_KEY} AS params_key FROM orders")
def _(s, d):
    return _candidates(s, d)


@query("prj_15_column_order", f"WITH {SUP} SELECT Segment_ID, slot_idx, event_date, {r('URA', 'IRI')} FROM sup")
def _(s, d):
    """Preferred columns first, absent ones skipped, extras behind them."""
    return col.ordered(fx.training(s, d).select("IRI", "URA", "Segment_ID", "event_date", "slot_idx"), ["Segment_ID", "event_date", "no_such_column", "URA"])


# Reshaping ----------------------------------------------------------------------------------------------------------

_DATE = "CASE WHEN slot_idx % 11 = 0 OR slot_idx % 13 = 0 THEN NULL ELSE date_trunc('day', event_date)::TIMESTAMP END"
_WIDE = f"WITH {RAW}, w AS (SELECT *, {_DATE} AS dt FROM raw WHERE KVL % 10 <> 0)"


@query("src_01_rsh_01_wide_measurements", f"{_WIDE} SELECT Segment_ID, slot_idx, dt AS event_date, round(IRI, 6) AS IRI, round(URA, 6) AS URA, 'PTM' AS event_type, 1 AS event_order FROM w WHERE event_type = 'PTM' AND year(dt) >= 1996 AND IRI BETWEEN 0 AND 10 AND URA BETWEEN 0 AND 40")
def _(s, d):
    """The wide table written and scanned again: key, length and the slots of three bases, found by their names."""
    path = tables.work_dir(s, "wide")
    tables.write_parquet(fx.wide(s, d), path)
    return reshape.measurements_long(tables.scan_wide(s, path, ["Segment_ID"], ["Pituus", "absent"], ["PTM_pvm", "Iri", "Ura_max"]), ["Segment_ID"], first_year=1996)


@query("prj_14_rsh_02_wide_treatments", f"{_WIDE} SELECT Segment_ID, slot_idx, dt AS event_date, Tp_pinta, Tp_tyomen, 'TP' AS event_type, 0 AS event_order FROM w WHERE event_type = 'TP' AND year(dt) >= 1996")
def _(s, d):
    return reshape.treatments_long(fx.wide(s, d), ["Segment_ID"], first_year=1996)


@query("flt_01_03_rsh_03_union", f"{_WIDE} SELECT Segment_ID, slot_idx, dt AS event_date, event_type, round(IRI, 6) AS IRI, round(URA, 6) AS URA, Tp_pinta, Tp_tyomen FROM w WHERE year(dt) >= 1996 AND (event_type = 'TP' OR (IRI BETWEEN 0 AND 10 AND URA BETWEEN 0 AND 40))")
def _(s, d):
    wide = fx.wide(s, d)
    both = reshape.union_events(reshape.measurements_long(wide, ["Segment_ID"], first_year=1996), reshape.treatments_long(wide, ["Segment_ID"], first_year=1996))
    return both.select("Segment_ID", "slot_idx", "event_date", "event_type", "IRI", "URA", "Tp_pinta", "Tp_tyomen")


@query("ddp_01_first_measurements", "SELECT user_id, event_type, min(value) AS v, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day, round(min(value) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)), 6) AS value FROM events) GROUP BY ALL")
def _(s, d):
    x = fx.view(s, d, "events").select("user_id", "event_type", F.to_date("ts").alias("event_date"), F.lit(1).alias("slot_idx"), F.round("value", 6).alias("IRI"), F.lit(0.0).alias("URA"))
    return reshape.first_measurements(x, ["user_id"]).groupBy("user_id", "event_type").agg(F.min("IRI").alias("v"), F.count("*").alias("n"))


@query("ddp_01_first_of_each_slot", "SELECT CAST(l_partkey AS BIGINT) AS part, CAST(l_shipdate AS DATE) AS event_date, l_linenumber AS slot_idx, round(l_tax, 6) AS IRI, round(l_quantity, 6) AS URA FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey % 50, CAST(l_shipdate AS DATE), l_linenumber ORDER BY l_tax, l_quantity, l_partkey) = 1".replace("CAST(l_partkey AS BIGINT)", "CAST(l_partkey % 50 AS BIGINT)"))
def _(s, d):
    """One measurement per group of parts, day and slot: lines of equal number on a day are repeats."""
    x = fx.view(s, d, "lineitem").select((F.col("l_partkey") % 50).cast("long").alias("part"), F.to_date("l_shipdate").alias("event_date"), F.lit("PTM").alias("event_type"), F.col("l_linenumber").alias("slot_idx"), F.col("l_tax").alias("IRI"), F.col("l_quantity").alias("URA"))
    return reshape.first_measurements(x, ["part"]).drop("event_type")


@query("ddp_02_first_treatments", f"WITH {RAW} SELECT DISTINCT Segment_ID, event_date, event_type, Tp_pinta, Tp_tyomen FROM raw WHERE event_type = 'TP'")
def _(s, d):
    x = fx.raw_events(s, d).where("event_type = 'TP'").withColumn("slot_idx", F.lit(1))
    return reshape.first_treatments(x, ["Segment_ID"]).select("Segment_ID", "event_date", "event_type", "Tp_pinta", "Tp_tyomen")


@query("ddp_04_duplicate_audit", "SELECT coalesce(sum(c), 0)::BIGINT AS duplicate_rows, count(*) AS duplicate_keys FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(s, d):
    return audit.duplicate_rows(fx.view(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ddp_05_assets_of_several", "SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, count(DISTINCT l_returnflag) AS strata FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def _(s, d):
    return splits.assets_of_several(fx.view(s, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("rsh_04_stack_horizons", f"WITH {FH}, st AS (" + " UNION ALL ".join(f"SELECT *, {h} AS h, target_IRI_{h}y AS ti, target_URA_{h}y AS tu, actual_horizon_years_{h}y AS ah FROM fh WHERE target_IRI_{h}y IS NOT NULL AND target_URA_{h}y IS NOT NULL" for h in (1, 2, 3, 4)) + f") SELECT Segment_ID, slot_idx, h AS forecast_horizon_years, {rx(target_URA='tu', actual_horizon_years='ah', stacked_delta_URA='tu - URA', baseline_trend_pred_URA='URA + h * CASE WHEN Delta_t_years > 0 THEN (URA - prev_URA) / Delta_t_years END')}, year(event_date)::BIGINT AS event_year FROM st")
def _(s, d):
    return supervised.stack_horizons(fx.horizons(s, d)).select("Segment_ID", "slot_idx", "forecast_horizon_years", "target_URA", "actual_horizon_years", "stacked_delta_URA", "baseline_trend_pred_URA", "event_year")


@query("rsh_06_crosstab", f"WITH {SUP}, c AS (SELECT tp_surface_type AS a, tp_material_type AS b, count(*) AS n, grouping(tp_surface_type) AS ga, grouping(tp_material_type) AS gb FROM sup GROUP BY CUBE (tp_surface_type, tp_material_type)) SELECT CASE WHEN ga = 1 THEN 'All' ELSE a END AS tp_surface_type, CASE WHEN gb = 1 THEN 'All' ELSE b END AS tp_material_type, n, round(n / sum(CASE WHEN gb = 0 THEN n END) OVER (PARTITION BY ga, a), 6) AS row_share FROM c")
def _(s, d):
    return reshape.crosstab(fx.training(s, d), "tp_surface_type", "tp_material_type")


@query("rsh_07_agg_09_pivot", f"WITH {SUP} SELECT ELY, " + ", ".join(f"round(sqrt(avg(CASE WHEN {_WIN.format(c='target_horizon_days')} = '{w}' THEN (target_next_URA - URA) ** 2 END)), 6) AS \"{w}\"" for w in ("short", "middle", "long")) + " FROM sup GROUP BY ELY")
def _(s, d):
    x = fx.training(s, d).withColumn("w", col.horizon_window(F.col("target_horizon_days"), fx.WINDOWS))
    return reshape.pivoted(x, ["ELY"], "w", ["short", "middle", "long"], F.sqrt(F.avg((F.col("target_next_URA") - F.col("URA")) ** 2)))


@query("rsh_08_agg_29_events_per_year", f"WITH {HIST} SELECT year, count(*) FILTER (event_type = 'PTM') AS PTM, count(*) FILTER (event_type = 'TP') AS TP FROM hist GROUP BY year")
def _(s, d):
    return reshape.pivoted(fx.history(s, d), ["year"], "event_type", ["PTM", "TP"], F.count(F.lit(1))).na.fill(0)


# Joins in time and windows ------------------------------------------------------------------------------------------


@query("joi_01_flt_07_semi_reduction", f"WITH {SEG} SELECT Segment_ID, slot_idx, event_type, event_date FROM seg")
def _(s, d):
    return history.semi_reduced(fx.events(s, d)).select("Segment_ID", "slot_idx", "event_type", "event_date")


@query("joi_02_interval_counts", f"WITH {P1} SELECT Segment_ID, slot_idx, tp_count_interval FROM p1")
def _(s, d):
    return history.interval_counts(history.measured_only(fx.events(s, d))).where("event_type = 'PTM'").select("Segment_ID", "slot_idx", "tp_count_interval")


@query("joi_03_04_treatment_context", f"WITH {HIST} SELECT Segment_ID, slot_idx, prev_meas_date, next_meas_date, days_since_prev_meas, days_until_next_meas, cycle_num, Lifecycle_ID, {r('Initial_URA', 'Pavement_Age_years')} FROM hist WHERE event_type = 'TP'")
def _(s, d):
    return fx.history(s, d).where("event_type = 'TP'").select("Segment_ID", "slot_idx", "prev_meas_date", "next_meas_date", "days_since_prev_meas", "days_until_next_meas", "cycle_num", "Lifecycle_ID", "Initial_URA", "Pavement_Age_years")


@query("joi_05_interval_classes", f"WITH {SUP} SELECT Segment_ID, slot_idx, tp_surface_type, tp_material_type FROM s0")
def _(s, d):
    return temporal.interval_classes(fx.history(s, d)).where("event_type = 'PTM'").select("Segment_ID", "slot_idx", "tp_surface_type", "tp_material_type")


@query("joi_06_asof_material", f"WITH {LATEST} SELECT m.Segment_ID, m.slot_idx, lx.d AS latest_material_event_date, {SURFACE.format(c='lx.s', n='unknown')} AS surface_type_current, {MATERIAL.format(c='lx.w', n='unknown')} AS material_type_current, round({days('m.event_date', 'lx.d')} / CAST(365.25 AS DOUBLE), 6) AS years_since_material_update FROM m LEFT JOIN lx USING (Segment_ID, slot_idx)")
def _(s, d):
    return temporal.current_material(fx.history(s, d)).where("event_type = 'PTM'").select("Segment_ID", "slot_idx", "latest_material_event_date", "surface_type_current", "material_type_current", "years_since_material_update")


_FHC = [f"{n}_{k}y" for k in (1, 2, 3) for n in ("IRI_hist", "URA_hist", "history_gap_years")] + [f"{n}_{h}y" for h in (1, 2, 3, 4) for n in ("target_IRI", "target_URA", "actual_horizon_years")]


@query("joi_07_nearest_within_tolerance", f"WITH {FH} SELECT Segment_ID, slot_idx, {r(*_FHC)} FROM fh")
def _(s, d):
    slim = fx.training(s, d).select("Segment_ID", "slot_idx", "Lifecycle_ID", "event_date", "Measurement_Idx", "IRI", "URA")
    return temporal.fixed_horizons(slim).select("Segment_ID", "slot_idx", *_FHC)


@query("joi_11_agg_20_one_asset", f"WITH {HIST} SELECT Event_Idx, event_type, event_date, round(URA, 6) AS URA, cycle_num FROM hist WHERE Segment_ID = '7'")
def _(s, d):
    return fx.history(s, d).where("Segment_ID = '7'").orderBy("Event_Idx").select("Event_Idx", "event_type", "event_date", "URA", "cycle_num")


@query("win_01_02_neighbours", f"WITH {P1} SELECT Segment_ID, slot_idx, prev_meas_date, next_meas_date, {r('prev_URA', 'prev_IRI', 'delta_URA', 'delta_IRI', 'Delta_t_days', 'Delta_t_years', 'days_since_prev_meas', 'days_until_next_meas')} FROM p1")
def _(s, d):
    return history.neighbours(history.measured_only(fx.events(s, d))).where("event_type = 'PTM'").select("Segment_ID", "slot_idx", "prev_meas_date", "next_meas_date", "prev_URA", "prev_IRI", "delta_URA", "delta_IRI", "Delta_t_days", "Delta_t_years", "days_since_prev_meas", "days_until_next_meas")


@query("win_03_07_lifecycles", f"WITH {P2} SELECT Segment_ID, slot_idx, has_TP_interval, is_major_reset, is_phantom_reset, is_minor_treatment, cycle_num, Measurement_Idx, Minor_TP_Count, Lifecycle_ID, {r('Initial_URA', 'Pavement_Age_years')} FROM m")
def _(s, d):
    return fx.measurements(s, d).select("Segment_ID", "slot_idx", "has_TP_interval", "is_major_reset", "is_phantom_reset", "is_minor_treatment", "cycle_num", "Measurement_Idx", "Minor_TP_Count", "Lifecycle_ID", "Initial_URA", "Pavement_Age_years")


@query("win_08_event_index", f"WITH {HIST} SELECT Segment_ID, event_type, slot_idx, Event_Idx, year FROM hist")
def _(s, d):
    return fx.history(s, d).select("Segment_ID", "event_type", "slot_idx", "Event_Idx", "year")


@query("win_09_10_flt_06_supervised", f"WITH {SUP} SELECT Segment_ID, slot_idx, target_next_event_date, target_next_measurement_idx, measurements_remaining_in_lifecycle, is_first_measurement_in_lifecycle, has_previous_measurement_in_lifecycle, has_next_measurement_in_lifecycle, {r('target_next_URA', 'target_next_IRI', 'target_horizon_days', 'target_horizon_years', 'baseline_persist_URA')} FROM sup")
def _(s, d):
    return fx.training(s, d).select("Segment_ID", "slot_idx", "target_next_event_date", "target_next_measurement_idx", "measurements_remaining_in_lifecycle", "is_first_measurement_in_lifecycle", "has_previous_measurement_in_lifecycle", "has_next_measurement_in_lifecycle", "target_next_URA", "target_next_IRI", "target_horizon_days", "target_horizon_years", "baseline_persist_URA")


@query("win_11_steps_ahead", f"WITH {P0} SELECT Segment_ID, slot_idx, round(lead(URA, 3) OVER w, 6) AS URA_plus_3, lead(event_date, 3) OVER w AS date_plus_3 FROM p0 WINDOW w AS (PARTITION BY Segment_ID ORDER BY event_date, slot_idx)")
def _(s, d):
    return supervised.steps_ahead(fx.measurements(s, d), 3).select("Segment_ID", "slot_idx", "URA_plus_3", "date_plus_3")


@query("win_12_error_concentration", f"WITH {SUP}, e AS (SELECT abs(target_next_URA - URA) AS e, count(*) AS n FROM sup GROUP BY 1) SELECT round(e, 6) AS abs_error, round(sum(n) OVER w / sum(n) OVER (), 6) AS row_share, round(sum(n * e) OVER w / sum(n * e) OVER (), 6) AS error_share FROM e WINDOW w AS (ORDER BY e DESC ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    x = fx.training(s, d).withColumn("e", F.col("target_next_URA") - F.col("URA"))
    return metrics.error_concentration(x, "e", ["Segment_ID", "slot_idx"])


@query("win_13_ecdf", f"WITH {P2}, e AS (SELECT has_TP_interval, delta_URA, count(*) AS n FROM m WHERE delta_URA IS NOT NULL GROUP BY ALL) SELECT has_TP_interval, round(delta_URA, 6) AS delta_URA, round(sum(n) OVER (PARTITION BY has_TP_interval ORDER BY delta_URA) / sum(n) OVER (PARTITION BY has_TP_interval), 6) AS cdf FROM e")
def _(s, d):
    return audit.ecdf(fx.measurements(s, d), "delta_URA", ["has_TP_interval"])


# Errors and splits --------------------------------------------------------------------------------------------------

_M = "count(*) AS rows, " + rx(mae="avg(abs({a} - {p}))", rmse="sqrt(avg(({a} - {p}) ** 2))", r2="CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({a}) > 0 THEN 1 - sum(({a} - {p}) ** 2) / (count(*) * var_pop({a})) WHEN sum(({a} - {p}) ** 2) = 0 THEN 1.0 ELSE 0.0 END")
_URA = _M.format(a="target_next_URA", p="URA")


@query("agg_01_02_ml_07_metrics", f"WITH {SUP} SELECT {_URA} FROM sup")
def _(s, d):
    return metrics.metrics(fx.training(s, d), "target_next_URA", "baseline_persist_URA")


_STACK = "st AS (" + " UNION ALL ".join(f"SELECT {h} AS h, target_IRI_{h}y AS ti, target_URA_{h}y AS tu, URA, IRI, URA + {h} * CASE WHEN Delta_t_years > 0 THEN (URA - prev_URA) / Delta_t_years END AS trend FROM fh WHERE target_IRI_{h}y IS NOT NULL AND target_URA_{h}y IS NOT NULL" for h in (1, 2, 3, 4)) + ")"
_LONG = "lg AS (SELECT h, 'persistence' AS model, 'URA' AS target, tu AS y, URA AS p FROM st UNION ALL SELECT h, 'trend', 'URA', tu, trend FROM st WHERE trend IS NOT NULL UNION ALL SELECT h, 'persistence', 'IRI', ti, IRI FROM st)"


@query("agg_03_model_target_horizon", f"WITH {FH}, {_STACK}, {_LONG} SELECT model, target, CASE WHEN grouping(h) = 1 THEN 'overall' ELSE 'forecast_horizon_years' END AS group_type, CASE WHEN grouping(h) = 1 THEN 'all' ELSE CAST(h AS VARCHAR) END AS group_value, {_M.format(a='y', p='p')} FROM lg GROUP BY GROUPING SETS ((model, target), (model, target, h))")
def _(s, d):
    x = supervised.stack_horizons(fx.horizons(s, d))
    tall = metrics.unpivot_predictors(x, ["forecast_horizon_years"], {
        "persistence/u": ("URA", "target_URA", "baseline_persist_pred_URA"), "trend/u": ("URA", "target_URA", "baseline_trend_pred_URA"), "persistence/i": ("IRI", "target_IRI", "baseline_persist_pred_IRI"),
    })
    return metrics.metrics_by_sets(tall, ["model", "target"], ["forecast_horizon_years"], "actual", "prediction")


_GROUPS = ("horizon_window", "ELY", "tp_surface_type", "tp_material_type", "Toim_lk")


@query("agg_04_05_flt_09_breakdown", f"WITH {SUP}, x AS (SELECT *, {_WIN.format(c='target_horizon_days')} AS horizon_window FROM sup) SELECT 'overall' AS group_type, 'all' AS group_value, {_URA}, round(avg(target_next_URA), 6) AS mean_actual FROM x " + " ".join(f"UNION ALL SELECT '{g}', {g}, {_URA}, round(avg(target_next_URA), 6) FROM x GROUP BY {g} HAVING count(*) >= 100" for g in _GROUPS))
def _(s, d):
    x = fx.training(s, d).withColumn("horizon_window", col.horizon_window(F.col("target_horizon_days"), fx.WINDOWS))
    return metrics.metrics_by_sets(x, [], _GROUPS, "target_next_URA", "baseline_persist_URA", least=100, more={"mean_actual": F.avg("target_next_URA")})


@query("agg_06_mae_by_region_horizon", f"WITH {FH}, st AS (" + " UNION ALL ".join(f"SELECT ELY, {h} AS forecast_horizon_years, abs(target_URA_{h}y - URA) AS eu, abs(target_IRI_{h}y - IRI) AS ei FROM fh WHERE target_IRI_{h}y IS NOT NULL AND target_URA_{h}y IS NOT NULL" for h in (1, 2, 3, 4)) + ") SELECT ELY, forecast_horizon_years, count(*) AS rows, round(avg(eu), 6) AS mae_URA, round(avg(ei), 6) AS mae_IRI FROM st GROUP BY ALL")
def _(s, d):
    x = supervised.stack_horizons(fx.horizons(s, d))
    return x.groupBy("ELY", "forecast_horizon_years").agg(F.count("*").alias("rows"), F.avg(F.abs("stacked_delta_URA")).alias("mae_URA"), F.avg(F.abs("stacked_delta_IRI")).alias("mae_IRI"))


def _binned(source: str, x: str, bins: int) -> str:
    cuts = ", ".join(f"quantile_cont({x}, {i / bins})" for i in range(bins + 1))
    return f"ed AS (SELECT list_sort(list_distinct([{cuts}])) AS edges FROM {source}), bx AS (SELECT *, greatest(len(list_filter(edges, lambda e: e < {x})) - 1, 0)::INT AS bin FROM {source}, ed WHERE {x} IS NOT NULL)"


@query("prj_24_agg_07_calibration", f"WITH {SUP}, {_binned('sup', 'URA', 20)} SELECT bin, count(*) AS rows, {rx(mean_predicted='avg(URA)', mean_actual='avg(target_next_URA)', mae='avg(abs(target_next_URA - URA))')} FROM bx GROUP BY bin")
def _(s, d):
    return metrics.calibration(fx.training(s, d), "target_next_URA", "URA")


@query("agg_08_driver_deciles", f"WITH {SUP}, {_binned('sup', 'Pavement_Age_years', 10)} SELECT bin, count(*) AS rows, {rx(mean_driver='avg(Pavement_Age_years)', median_driver='quantile_cont(Pavement_Age_years, 0.5)', mean_actual='avg(target_next_URA)', mean_predicted='avg(URA)', rmse='sqrt(avg((target_next_URA - URA) ** 2))')} FROM bx GROUP BY bin")
def _(s, d):
    return metrics.driver_profile(fx.training(s, d), "Pavement_Age_years", "target_next_URA", "URA")


@query("prj_23_agg_10_errors_by_bin", f"WITH {SUP}, x AS (SELECT abs(target_next_URA - URA) AS e, CASE WHEN target_horizon_years >= 0 AND target_horizon_years <= 0.25 THEN 'a' WHEN target_horizon_years <= 0.5 THEN 'b' WHEN target_horizon_years <= 1 THEN 'c' WHEN target_horizon_years <= 10 THEN 'd' END AS bin FROM sup) SELECT bin, count(*) AS n, {rx(mean_error='avg(e)', median_error='quantile_cont(e, 0.5)')} FROM x WHERE bin IS NOT NULL GROUP BY bin")
def _(s, d):
    x = fx.training(s, d).select(F.abs(F.col("target_next_URA") - F.col("URA")).alias("e"), col.cut_bins(F.col("target_horizon_years"), [0, 0.25, 0.5, 1, 10], ["a", "b", "c", "d"], include_lowest=True).alias("bin"))
    return metrics.errors_by_bin(x, "bin", "e")


@query("joi_09_agg_11_gain", f"WITH {FH}, {_STACK}, {_LONG}, g AS (SELECT model, h, sqrt(avg((y - p) ** 2)) AS rmse FROM lg WHERE target = 'URA' GROUP BY model, h) SELECT a.h AS forecast_horizon_years, {rx(rmse='a.rmse', persistence_rmse='b.rmse', gain='b.rmse - a.rmse', gain_pct='(b.rmse - a.rmse) / b.rmse * 100')} FROM g a JOIN g b ON a.h = b.h WHERE a.model = 'trend' AND b.model = 'persistence'")
def _(s, d):
    x = supervised.stack_horizons(fx.horizons(s, d))

    found = {n: F.sqrt(F.avg((F.col("target_URA") - F.col(f"baseline_{n}_pred_URA")) ** 2)) for n in ("trend", "persist")}
    both = tables.stored(x.groupBy("forecast_horizon_years").agg(*(c.alias(n) for n, c in found.items())))  # both errors by one pass over the chain
    trend, persist = (both.select("forecast_horizon_years", F.col(n).alias("rmse")) for n in found)
    return metrics.with_gain(trend, persist, ["forecast_horizon_years"])


_SPLIT = """n0 AS (SELECT DISTINCT Segment_ID, ELY FROM sup),
n1 AS (SELECT *, count(*) OVER (PARTITION BY ELY) AS n, row_number() OVER (PARTITION BY ELY ORDER BY md5('42|' || Segment_ID), Segment_ID) AS k FROM n0),
n2 AS (SELECT *, (CASE WHEN n >= 3 THEN least(greatest(round_even(n * CAST(0.7 AS DOUBLE), 0), 1), n - 2) ELSE greatest(n - 2, 0) END)::BIGINT AS t FROM n1),
n3 AS (SELECT *, (CASE WHEN n - t >= 2 THEN least(greatest(round_even(n * CAST(0.15 AS DOUBLE), 0), 1), n - t - 1) ELSE greatest(n - t - 1, 0) END)::BIGINT AS v FROM n2),
sp AS (SELECT Segment_ID, CASE WHEN k <= t THEN 'train' WHEN k <= t + v THEN 'validation' ELSE 'test' END AS split FROM n3)"""


@query("spl_01_win_15_stratified_split", f"WITH {SUP}, {_SPLIT} SELECT Segment_ID, split FROM sp")
def _(s, d):
    return splits.stratified_assets(fx.training(s, d), "Segment_ID", "ELY")


@query("joi_08_agg_37_split_diagnostics", f"WITH {SUP}, {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT Segment_ID) AS segments, {rx(mean_horizon='avg(target_horizon_days)', std_horizon='stddev_samp(target_horizon_days)', mean_target='avg(target_next_URA)', std_target='stddev_samp(target_next_URA)', min_target='min(target_next_URA)', max_target='max(target_next_URA)')} FROM sup JOIN sp USING (Segment_ID) GROUP BY split")
def _(s, d):
    x = fx.training(s, d)
    return audit.split_diagnostics(splits.with_split(x, splits.stratified_assets(x, "Segment_ID", "ELY"), "Segment_ID"))


@query("agg_37_split_leaks", f"WITH {SUP}, q AS (SELECT Segment_ID, CASE WHEN year < 1996 THEN 'train' WHEN year = 1996 THEN 'validation' ELSE 'test' END AS split FROM sup WHERE year <= 1998) SELECT Segment_ID, count(DISTINCT split) AS splits FROM q GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(s, d):
    """Assets that a split by year shares among its parts."""
    return splits.leaks(splits.by_year(fx.training(s, d), "year", 1996, 1996, (1997, 1998)), "Segment_ID")


@query("agg_37_asset_split_has_no_leaks", "SELECT 'x' AS Segment_ID, 0::BIGINT AS splits WHERE false")
def _(s, d):
    x = fx.training(s, d)
    return splits.leaks(splits.with_split(x, splits.stratified_assets(x, "Segment_ID", "ELY"), "Segment_ID"), "Segment_ID")


_KINDS = "k AS (SELECT 'year' AS kind, Segment_ID, CASE WHEN year < 1996 THEN 'train' WHEN year = 1996 THEN 'validation' ELSE 'test' END AS split FROM sup WHERE year <= 1998 UNION ALL SELECT 'asset', Segment_ID, split FROM sup JOIN sp USING (Segment_ID))"


@query("agg_37_leaks_by_kind_of_split", f"WITH {SUP}, {_SPLIT}, {_KINDS}, a AS (SELECT kind, Segment_ID, count(*) AS n, count(DISTINCT split) AS splits FROM k GROUP BY ALL) SELECT kind, count(*) AS assets, count(*) FILTER (splits > 1) AS leaking_assets, sum(n)::BIGINT AS rows FROM a GROUP BY kind")
def _(s, d):
    """Assets that a split by year shares among its parts, beside the split by assets, which shares none."""
    x = fx.training(s, d).select("Segment_ID", "ELY", "year")
    by_asset = splits.with_split(x, splits.stratified_assets(x, "Segment_ID", "ELY"), "Segment_ID").select(F.lit("asset").alias("kind"), "Segment_ID", "split")
    both = splits.by_year(x, "year", 1996, 1996, (1997, 1998)).select(F.lit("year").alias("kind"), "Segment_ID", "split").unionByName(by_asset)
    per = both.groupBy("kind", "Segment_ID").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return per.groupBy("kind").agg(F.count("*").alias("assets"), F.count_if(F.col("splits") > 1).alias("leaking_assets"), F.sum("n").alias("rows"))


@query("agg_38_spl_02_date_cutoff", "WITH o AS (SELECT DISTINCT o_orderdate AS x FROM orders), k AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM o), c AS (SELECT x FROM k WHERE i = least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 1), n - 1)) SELECT CASE WHEN o_orderdate < x THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(o_orderdate) AS first_date FROM orders, c GROUP BY 1")
def _(s, d):
    x = fx.view(s, d, "orders")
    return splits.chronological(x, "o_orderdate", splits.date_cutoff(x, "o_orderdate")).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"))


@query("spl_03_year_split", f"WITH {SUP} SELECT CASE WHEN year < 1999 THEN 'train' WHEN year = 1999 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM sup WHERE year <= 2001 GROUP BY 1")
def _(s, d):
    return splits.by_year(fx.training(s, d), "year", 1999, 1999, (2000, 2001)).groupBy("split").agg(F.count("*").alias("n"))


@query("ord_04_exact_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def _(s, d):
    return splits.exact_sample(fx.view(s, d, "orders"), 500, 42, "o_orderkey").select("o_orderkey", "o_custkey")


@query("ord_05_eligible_asset", f"WITH {HIST} SELECT Segment_ID FROM hist GROUP BY Segment_ID HAVING count(*) >= 20 AND count(*) FILTER (event_type = 'PTM') >= 10 ORDER BY md5('42|' || Segment_ID), Segment_ID LIMIT 1")
def _(s, d):
    x = audit.asset_summary(fx.history(s, d)).where("n_events >= 20 and n_ptm >= 10")
    return splits.exact_sample(x, 1, 42, "Segment_ID").select("Segment_ID")


_RES = f"WITH {SUP}, res AS (SELECT ELY, Toim_lk, sqrt(avg((target_next_URA - URA) ** 2)) AS rmse, count(*) AS n FROM sup GROUP BY ELY, Toim_lk)"


def _results(s, d):
    return fx.training(s, d).groupBy("ELY", "Toim_lk").agg(F.round(F.sqrt(F.avg((F.col("target_next_URA") - F.col("URA")) ** 2)), 9).alias("rmse"), F.count("*").alias("n"))


@query("ord_02_leaderboard", f"{_RES} SELECT ELY, Toim_lk, round(rmse, 6) AS rmse, n FROM res ORDER BY round(rmse, 9), ELY, Toim_lk LIMIT 10")
def _(s, d):
    return metrics.leaderboard(_results(s, d), "rmse", ["ELY", "Toim_lk"], 10)


@query("ord_03_ml_16_best_per_group", f"{_RES} SELECT ELY, Toim_lk, round(rmse, 6) AS rmse, n FROM res QUALIFY row_number() OVER (PARTITION BY ELY ORDER BY round(rmse, 9), Toim_lk) = 1")
def _(s, d):
    return metrics.best_per_group(_results(s, d), ["ELY"], "rmse", ["Toim_lk"])


# Audits -------------------------------------------------------------------------------------------------------------

_IG = "WHERE delta_URA IS NOT NULL AND delta_IRI IS NOT NULL"


@query("agg_12_drop_summary", f"WITH {P2} SELECT CASE WHEN has_TP_interval THEN 'TP in interval' ELSE 'No TP in interval' END AS tp_interval_group, count(*) AS n, {rx(share_of_ptm_intervals='count(*) / sum(count(*)) OVER ()', ura_negative_share='avg((delta_URA < 0)::INT)', ura_le_minus_1_share='avg((delta_URA <= -1)::INT)', ura_le_minus_3_share='avg((delta_URA <= -3)::INT)', iri_negative_share='avg((delta_IRI < 0)::INT)', ura_mean='avg(delta_URA)', iri_mean='avg(delta_IRI)')} FROM m {_IG} GROUP BY 1")
def _(s, d):
    return audit.drop_summary(fx.measurements(s, d))


def _sweep(thresholds, extra: str) -> str:
    hit = f"(delta_URA <= t{extra})"
    return (
        f"WITH {P2}, x AS (SELECT *, unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in thresholds)}]) AS t FROM m {_IG}), y AS (SELECT t AS threshold, avg({hit}::INT) FILTER (has_TP_interval) AS tp_rate_proxy, avg({hit}::INT) FILTER (NOT has_TP_interval) AS no_tp_rate, "
        f"count(*) FILTER (has_TP_interval AND {hit}) AS tp_hits, count(*) FILTER (NOT has_TP_interval AND {hit}) AS no_tp_hits FROM x GROUP BY t) "
        "SELECT threshold, round(tp_rate_proxy, 6) AS tp_rate_proxy, round(no_tp_rate, 6) AS no_tp_rate, tp_hits, no_tp_hits, round(tp_hits / nullif(tp_hits + no_tp_hits, 0), 6) AS precision_proxy, round(tp_rate_proxy / nullif(no_tp_rate, 0), 6) AS lift_tp_vs_no_tp FROM y"
    )


@query("agg_13_threshold_sweep", _sweep(audit.SWEEP, ""))
def _(s, d):
    return audit.threshold_sweep(fx.measurements(s, d))


@query("agg_14_corroborated_sweep", _sweep(audit.CORROBORATED, " AND delta_IRI < 0"))
def _(s, d):
    return audit.threshold_sweep(fx.measurements(s, d), audit.CORROBORATED, corroborated=True)


_GAP = "CASE WHEN Delta_t_years < 0 THEN NULL WHEN Delta_t_years <= 0.75 THEN '<=0.75y' WHEN Delta_t_years <= 1.5 THEN '0.75-1.5y' WHEN Delta_t_years <= 2.5 THEN '1.5-2.5y' WHEN Delta_t_years <= 4 THEN '2.5-4y' WHEN Delta_t_years <= 10 THEN '4-10y' ELSE '10y+' END"
_LVL = "CASE WHEN prev_URA <= 5 THEN '<=5' WHEN prev_URA <= 10 THEN '5-10' WHEN prev_URA <= 15 THEN '10-15' WHEN prev_URA <= 20 THEN '15-20' WHEN prev_URA <= 25 THEN '20-25' WHEN prev_URA <= 30 THEN '25-30' WHEN prev_URA <= 40 THEN '30-40' ELSE '40+' END"
_UT = f"WITH {P2}, u AS (SELECT *, {_GAP} AS gap_bin, {_LVL} AS prev_URA_bin FROM m {_IG} AND NOT has_TP_interval)"
_BP = "count(*) AS n, " + rx(mean_delta_URA="avg(delta_URA)", q01_delta_URA="quantile_cont(delta_URA, 0.01)", q05_delta_URA="quantile_cont(delta_URA, 0.05)", share_delta_URA_le_minus_3="avg((delta_URA <= -3)::INT)", share_delta_URA_le_minus_5="avg((delta_URA <= -5)::INT)", mean_delta_IRI="avg(delta_IRI)", share_delta_IRI_negative="avg((delta_IRI < 0)::INT)")

for _name, _column in (("agg_15_gap_profile", "gap_bin"), ("agg_15_level_profile", "prev_URA_bin")):
    query(_name, f"{_UT} SELECT {_column}, {_BP} FROM u GROUP BY {_column}")(lambda s, d, c=_column: audit.bin_profile(audit.untreated(fx.measurements(s, d)), c))


@query("agg_16_severe_drops", f"{_UT}, x AS (SELECT *, unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in audit.CORROBORATED)}]) AS t FROM u) SELECT t AS threshold, count(*) FILTER (delta_URA <= t) AS n, {rx(share_of_no_tp='avg((delta_URA <= t)::INT)', share_delta_IRI_negative='avg((delta_IRI < 0)::INT) FILTER (delta_URA <= t)', share_delta_IRI_le_minus_0_5='avg((delta_IRI <= -0.5)::INT) FILTER (delta_URA <= t)')} FROM x GROUP BY t HAVING count(*) FILTER (delta_URA <= t) > 0")
def _(s, d):
    return audit.severe_drops(audit.untreated(fx.measurements(s, d)))


@query("agg_17_heat_table", f"{_UT} SELECT gap_bin, prev_URA_bin, count(*) AS n, round(avg((delta_URA <= -3)::INT), 6) AS drop_rate FROM u GROUP BY ALL")
def _(s, d):
    return audit.heat_table(audit.untreated(fx.measurements(s, d)))


@query("agg_18_asset_summary", f"WITH {HIST} SELECT Segment_ID, count(*) AS n_events, count(*) FILTER (event_type = 'PTM') AS n_ptm, count(*) FILTER (event_type = 'TP') AS n_tp, min(event_date) AS first_date, max(event_date) AS last_date, count(DISTINCT Lifecycle_ID) AS n_lifecycles, {rx(min_URA='min(URA)', max_URA='max(URA)', min_IRI='min(IRI)', max_IRI='max(IRI)')} FROM hist GROUP BY Segment_ID")
def _(s, d):
    return audit.asset_summary(fx.history(s, d))


@query("agg_19_lifecycle_summary", f"WITH {HIST} SELECT Lifecycle_ID, min_by(Segment_ID, Event_Idx) AS Segment_ID, count(*) AS n_events, count(*) FILTER (event_type = 'PTM') AS n_ptm, count(*) FILTER (event_type = 'TP') AS n_tp, min(event_date) AS start_date, max(event_date) AS end_date, round(max(Pavement_Age_years), 6) AS max_age_years FROM hist WHERE Lifecycle_ID IS NOT NULL GROUP BY Lifecycle_ID")
def _(s, d):
    return audit.lifecycle_summary(fx.history(s, d))


def _tall(source: str, pairs: dict[str, str], name: str = "metric", value: str = "value", kind: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {name}, round(CAST({e} AS {kind}), 6) AS {value} FROM {source}" if kind == "DOUBLE" else f"SELECT '{k}' AS {name}, CAST({e} AS {kind}) AS {value} FROM {source}" for k, e in pairs.items())


def _if(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


@query("agg_21_integrity", f"WITH {HIST} " + _tall("hist", {
    "rows": "count(*)", "missing_segment": _if("Segment_ID IS NULL"), "missing_date": _if("event_date IS NULL"), "unknown_type": _if("event_type NOT IN ('PTM', 'TP')"), "ptm_wrong_order": _if("event_type = 'PTM' AND event_order <> 1"),
    "tp_wrong_order": _if("event_type = 'TP' AND event_order <> 0"), "missing_slot": _if("slot_idx IS NULL"), "ptm_missing_URA": _if("event_type = 'PTM' AND URA IS NULL"), "ptm_missing_IRI": _if("event_type = 'PTM' AND IRI IS NULL"),
    "tp_missing_surface": _if("event_type = 'TP' AND Tp_pinta IS NULL"), "tp_missing_method": _if("event_type = 'TP' AND Tp_tyomen IS NULL"), "ptm_missing_lifecycle": _if("event_type = 'PTM' AND Lifecycle_ID IS NULL"),
}))
def _(s, d):
    return audit.integrity(fx.history(s, d))


@query("agg_22_range_audit", f"WITH {HIST} " + _tall("hist", {n: _if(f"{c} {o} {b}") for n, c, o, b in audit.RANGE_RULES}, "rule", "count", "BIGINT"))
def _(s, d):
    return audit.range_audit(fx.history(s, d))


_MISS = ("URA", "IRI", "Tp_pinta", "Tp_tyomen", "Lifecycle_ID", "prev_meas_date")


@query("agg_23_missing", f"WITH {HIST} " + " UNION ALL ".join(f"SELECT event_type, '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM hist GROUP BY event_type" for c in _MISS))
def _(s, d):
    return audit.missing(fx.history(s, d), _MISS, ["event_type"])


_NUM = ("URA", "IRI", "delta_URA", "Delta_t_days", "Pavement_Age_years")
_PCT = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("agg_24_describe", f"WITH {P2} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, {rx(mean=f'avg({c})', std=f'stddev_samp({c})', min=f'min({c})')}, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(p * 100):02d}" for p in _PCT) + f", round(max({c}), 6) AS max FROM m" for c in _NUM))
def _(s, d):
    return audit.describe(fx.measurements(s, d), _NUM)


@query("agg_25_extremes", f"WITH {P2} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, {rx(min=f'min({c})', max=f'max({c})', mean=f'avg({c})', median=f'quantile_cont({c}, 0.5)')}, count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} = 0) AS zero FROM m" for c in _NUM))
def _(s, d):
    return audit.extremes(fx.measurements(s, d), _NUM)


@query("agg_26_value_counts", f"WITH {HIST} SELECT coalesce(Tp_pinta, 'missing') AS Tp_pinta, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM hist GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(s, d):
    return audit.value_counts(fx.history(s, d), "Tp_pinta", 30)


@query("win_14_shares_by_group", f"WITH {HIST} SELECT event_type, coalesce(ELY, 'missing') AS ELY, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM hist GROUP BY 1, 2")
def _(s, d):
    return audit.value_counts(fx.history(s, d), "ELY", by=["event_type"])


@query("agg_27_histogram", f"WITH {P2}, l AS (SELECT min(delta_URA) AS lo, max(delta_URA) AS hi FROM m), b AS (SELECT has_TP_interval, least(floor((delta_URA - lo) / ((hi - lo) / 25)), 24)::INT AS bin, lo, hi FROM m, l WHERE delta_URA IS NOT NULL) SELECT has_TP_interval, bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 25), 6) AS low, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY has_TP_interval), 6) AS share FROM b GROUP BY has_TP_interval, bin")
def _(s, d):
    return audit.histogram(fx.measurements(s, d), "delta_URA", 25, ["has_TP_interval"])


@query("agg_28_events_per_asset", f"WITH {HIST}, c AS (SELECT count(*) AS n FROM hist GROUP BY Segment_ID) SELECT n AS events, count(*) AS assets FROM c GROUP BY n")
def _(s, d):
    return fx.history(s, d).groupBy("Segment_ID").agg(F.count("*").alias("events")).groupBy("events").agg(F.count("*").alias("assets"))


_COR = ("URA", "IRI", "delta_URA", "delta_IRI", "Pavement_Age_years")
_PAIRS = [(a, b) for i, a in enumerate(_COR) for b in _COR[i + 1 :]]


@query("agg_30_correlations", f"WITH {P2} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM m" for a, b in _PAIRS))
def _(s, d):
    return audit.correlations(fx.measurements(s, d), _COR)


@query("agg_31_flag_counts", f"WITH {HIST} SELECT event_type, is_major_reset, has_TP_interval, count(*) AS n FROM hist GROUP BY ALL")
def _(s, d):
    return fx.history(s, d).groupBy("event_type", "is_major_reset", "has_TP_interval").agg(F.count("*").alias("n"))


_KN = f"WITH {SUP}, k AS (SELECT *, tp_surface_type NOT IN ('none', 'other') AS surface_known, tp_material_type NOT IN ('none', 'other') AS material_known FROM sup)"


@query("prj_25_agg_32_coverage", f"{_KN} " + _tall("k", {
    "surface_known_share": "avg(surface_known::INT)", "material_known_share": "avg(material_known::INT)", "both_known_share": "avg((surface_known AND material_known)::INT)",
    "has_TP_interval_share": "avg(has_TP_interval::INT)", "mean_tp_count_interval": "avg(tp_count_interval)", "median_tp_count_interval": "quantile_cont(tp_count_interval, 0.5)",
}))
def _(s, d):
    return audit.coverage(audit.knownness(fx.training(s, d)))


@query("agg_33_coverage_by_year", f"{_KN} SELECT year, count(*) AS rows, {rx(surface_known_share='avg(surface_known::INT)', material_known_share='avg(material_known::INT)', both_known_share='avg((surface_known AND material_known)::INT)')} FROM k GROUP BY year")
def _(s, d):
    return audit.coverage_by(audit.knownness(fx.training(s, d)), "year")


@query("agg_34_flt_12_edge_counters", f"WITH {SUP} " + _tall("sup", {
    "tp_but_surface_none": _if("has_TP_interval AND tp_surface_type = 'none'"), "tp_but_material_none": _if("has_TP_interval AND tp_material_type = 'none'"), "tp_but_surface_other": _if("has_TP_interval AND tp_surface_type = 'other'"),
    "tp_but_material_other": _if("has_TP_interval AND tp_material_type = 'other'"), "no_tp_but_surface": _if("NOT has_TP_interval AND tp_surface_type <> 'none'"), "no_tp_but_material": _if("NOT has_TP_interval AND tp_material_type <> 'none'"),
}))
def _(s, d):
    return audit.edge_counters(fx.training(s, d))


@query("flt_12_edge_rows", f"WITH {SUP} SELECT Segment_ID, slot_idx, tp_count_interval, tp_surface_type, tp_material_type FROM sup WHERE has_TP_interval AND (tp_surface_type IN ('none', 'other') OR tp_material_type IN ('none', 'other'))")
def _(s, d):
    return audit.edge_rows(fx.training(s, d)).select("Segment_ID", "slot_idx", "tp_count_interval", "tp_surface_type", "tp_material_type")


@query("agg_34_tp_count_distribution", f"WITH {SUP} SELECT tp_count_interval, count(*) AS n FROM sup GROUP BY 1")
def _(s, d):
    return fx.training(s, d).groupBy("tp_count_interval").agg(F.count("*").alias("n"))


@query("agg_35_table_summary", f"WITH {SUP} SELECT count(*) AS rows, count(DISTINCT Segment_ID) AS segments, count(DISTINCT Lifecycle_ID) AS lifecycles, min(event_date) AS first_date, max(event_date) AS last_date, {rx(mean_horizon_days='avg(target_horizon_days)', median_horizon_days='quantile_cont(target_horizon_days, 0.5)')}, count(*) - count(target_next_URA) AS missing_target FROM sup")
def _(s, d):
    return audit.table_summary(fx.training(s, d))


@query("agg_36_horizon_coverage", f"WITH {FH} " + " UNION ALL ".join(f"SELECT {h} AS horizon, count(target_URA_{h}y) AS rows, round(count(target_URA_{h}y) / count(*), 6) AS share, round(avg(actual_horizon_years_{h}y), 6) AS mean_actual_years FROM fh" for h in (1, 2, 3, 4)))
def _(s, d):
    return audit.horizon_coverage(fx.horizons(s, d))


@query("agg_39_quantile_grid", f"WITH {SUP} SELECT DISTINCT round(unnest([" + ", ".join(f"quantile_cont(KVL, {p})" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + "]), 6) AS grid_value FROM sup")
def _(s, d):
    return audit.quantile_grid(fx.training(s, d), "KVL")

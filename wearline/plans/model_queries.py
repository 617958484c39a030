"""Queries that fit models on the training table; fitted values are checked by properties, the tables around them by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import fixtures as fx
from wearline.functions import columns as col
from wearline.operators import audit, history, metrics, reshape, splits, temporal
from wearline.operators.history import ASSET
from wearline.operators.metrics import metrics_by_sets
from wearline.operators.supervised import supervised
from wearline.plans import estimators, models
from wearline.plans.catalog import _RES, _SPLIT, _results, query, r, rx
from wearline.plans.oracle_views import HIST, MATERIAL, SUP, SURFACE
from wearline.sources import tables
from wearline.sources.tables import stored

FULL = models.FEATURE_MIXTURES["current_static_lag_lifecycle_material"]
CURRENT = models.FEATURE_MIXTURES["current"]
#: Targets with the columns of their current level.
TARGETS = {"target_next_URA": "URA", "target_next_IRI": "IRI"}
def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised(temporal.current_material(fx.history(spark, sf_dir))).withColumn("observed_lifecycle_age_years", F.col("Pavement_Age_years"))


def _with_split(table: DataFrame, tasks: int) -> DataFrame:
    """``table`` with each asset's split, written once since each fit reads it several times.

    It is written before its assets are split, so that it is made once, and both sides are dealt among ``tasks`` tasks: left to
    Spark, the join has a fixed number of tasks, each of which sorts its share of the wide rows.
    """
    table = stored(table, "training")
    split = splits.stratified_assets(table, ASSET, "ELY")
    return stored(splits.with_split(*(x.repartition(tasks, ASSET) for x in (table, split)), ASSET), "training")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows of the training table."""
    split = _with_split(_table(spark, sf_dir), fx.parts(spark, sf_dir))
    return tuple(split.where(F.col("split") == n) for n in ("train", "validation", "test"))


#: The training table with split, current material and alias, in SQL.
_FULL = f"""WITH {SUP}, {_SPLIT}, lp AS (
  SELECT sup.*, sp.split, Pavement_Age_years AS observed_lifecycle_age_years, lx.d AS latest_material_event_date,
    {SURFACE.format(c='lx.s', n='unknown')} AS surface_type_current, {MATERIAL.format(c='lx.w', n='unknown')} AS material_type_current,
    CASE WHEN lx.d IS NOT NULL THEN 1.0 END AS years_since_material_update
  FROM sup JOIN sp USING (Segment_ID) LEFT JOIN lx USING (Segment_ID, slot_idx))"""


def _mixture_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS feature_mixture, {len(v)} AS n_features, '{', '.join(v)}' AS features, count(*) FILTER ({' AND '.join(f'{f} IS NOT NULL' for f in v)}) AS complete_rows FROM lp WHERE split = 'train'"
        for k, v in models.FEATURE_MIXTURES.items()
    )


@query("ml_01_rsh_09_feature_mixtures", f"{_FULL} {_mixture_rows()}")
def _(s, d):
    """Each mixture's features and the training rows that have all of them."""
    train, _, _ = _split(s, d)
    full = train.agg(*(F.count_if(reduce(lambda x, y: x & y, (F.col(f).isNotNull() for f in v))).alias(k) for k, v in models.FEATURE_MIXTURES.items()))
    return reshape.feature_lists(s, models.FEATURE_MIXTURES).join(F.broadcast(audit.tall(full, list(models.FEATURE_MIXTURES), "feature_mixture", "complete_rows")), "feature_mixture")


_ASKED = [*CURRENT, "target_next_URA", "ELY", "year", "baseline_persist_IRI", "tp_surface_type", "Tie", "no_such_column"]
_ABSENT = ("Tie", "no_such_column")
_BAD = [(f, "leaks the target") for f in _ASKED if f in models.FORBIDDEN] + [(f, "missing") for f in _ABSENT]


@query("flt_11_feature_guard", f"WITH {SUP} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{fault}' AS fault, {'0 * count(*)' if f in _ABSENT else f'count({f})'} AS rows FROM sup" for f, fault in _BAD))
def _(s, d):
    """Faulty features of a list, with the rows in which they have a value."""
    table = fx.training(s, d)
    bad = models.violations(table.columns, _ASKED)
    present = [f for f in dict.fromkeys(f for f, _ in bad) if f in table.columns]
    counts = audit.tall(table.agg(*(F.count(f).alias(f) for f in present)), present, "feature", "rows")
    return s.createDataFrame(bad, "feature string, fault string").join(F.broadcast(counts), "feature", "left").na.fill(0, ["rows"])


_NUMERIC = ("URA", "IRI", "KVL", "KVL_kaista", "prev_URA", "Delta_t_years", "target_horizon_years")


@query("ml_02_medians", f"{_FULL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM lp WHERE split = 'train'" for c in _NUMERIC))
def _(s, d):
    """Fills of numeric features, from the training rows alone."""
    train, _, _ = _split(s, d)
    return s.createDataFrame(list(models.medians(train, _NUMERIC).items()), "feature string, median double")


@query("ml_03_scaling", f"{_FULL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(coalesce({c}, m)), 6) AS mean, round(stddev_pop(coalesce({c}, m)), 6) AS deviation FROM lp, (SELECT quantile_cont({c}, 0.5) AS m FROM lp WHERE split = 'train') WHERE split = 'train'" for c in _NUMERIC))
def _(s, d):
    """Means and deviations by which numeric features are scaled, after the fills, from the training rows alone."""
    train, _, _ = _split(s, d)
    return models.scaling(train, _NUMERIC)


_NAMED = ("Toim_lk", "ELY", "surface_type_current", "material_type_current")


@query("ml_04_modes", f"{_FULL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS feature, {c} AS mode FROM lp WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _NAMED))
def _(s, d):
    """Most frequent values of category features in the training rows (ties: the smallest)."""
    train, _, _ = _split(s, d)
    return s.createDataFrame(list(models.modes(train, _NAMED).items()), "feature string, mode string")


_PROBED = ("URA", "prev_URA", "prev_IRI", "Delta_t_years", "KVL")


@query("flt_10_empty_columns", f"WITH {SUP} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS rows, count({c}) = 0 AS dropped FROM sup WHERE prev_meas_date IS NULL" for c in _PROBED))
def _(s, d):
    """Features without a value, which a fit drops: first measurements have no previous one."""
    first = fx.training(s, d).where("prev_meas_date is null")
    gone = models.empty_columns(first, _PROBED)
    counts = audit.tall(first.agg(*(F.count(c).alias(c) for c in _PROBED)), list(_PROBED), "feature", "rows")
    return counts.withColumn("dropped", F.col("feature").isin(gone))


@query("flt_08_horizon_bands", f"WITH {SUP} " + " UNION ALL ".join(f"SELECT '{n}' AS band, Segment_ID, slot_idx, round(target_horizon_days, 6) AS target_horizon_days FROM sup WHERE target_horizon_days BETWEEN {a} AND {b}" for n, a, b in (*col.HORIZON_WINDOWS, *fx.WINDOWS)))
def _(s, d):
    """The rows of each horizon band, of the fixed ones and of the shorter ones that these data have more of."""
    table = fx.training(s, d)
    return models.bands(table, (*col.HORIZON_WINDOWS, *fx.WINDOWS)).select("band", "Segment_ID", "slot_idx", "target_horizon_days")


@query("prj_18_lifecycle_age", f"WITH {SUP} SELECT Segment_ID, slot_idx, {rx(observed_lifecycle_age_years='Pavement_Age_years')} FROM sup")
def _(s, d):
    return _table(s, d).select("Segment_ID", "slot_idx", "observed_lifecycle_age_years")


def _named(candidates, kind: str) -> dict[str, estimators.Estimator]:
    """Candidates of a stated grid by name and number."""
    return {f"{kind}_{i}": estimators.KINDS[kind](*c) for i, c in enumerate(candidates, 1)}


@query("ml_06_12_15_validation_grid")
def _(s, d):
    """Linear models of all mixtures, both targets, direct and as differences, with persistence beside them."""
    train, valid, _ = _split(s, d)
    linear = {k: v for k, v in models.estimators().items() if k in ("linear", "ridge")}
    return models.grids(train, valid, models.FEATURE_MIXTURES, TARGETS, linear, ("direct", "delta"))


@query("ml_12_tree_grid")
def _(s, d):
    """Forests and boosted trees of all mixtures and both targets."""
    train, valid, _ = _split(s, d)
    trees = {k: v for k, v in models.estimators().items() if k in ("random_forest", "boosted_trees")}
    return models.grids(train, valid, models.FEATURE_MIXTURES, TARGETS, trees)


def _tuning(train: DataFrame, valid: DataFrame) -> dict[str, DataFrame]:
    """The result table of each tuning stage."""
    mixture = {"current_static_lag_lifecycle_material": FULL}
    coarse = {**_named(models.BOOSTED_GRID, "boosted_trees"), **_named(models.FOREST_GRID, "random_forest")}
    return {
        "coarse": models.grid(train, valid, mixture, "target_next_URA", coarse),
        "focused": models.grid(train, valid, mixture, "target_next_URA", _named(models.FOCUSED_GRID, "boosted_trees"), ("delta",)),
    }


@query("ml_13_23_tuning")
def _(s, d):
    """All candidates of the tuning stages on the actual scale, and the best of each stage."""
    train, valid, _ = _split(s, d)
    stages = _tuning(train, valid)
    best = models.progression(stages).select("stage", F.col("model").alias("best_model"))
    tagged = [rows.withColumn("stage", F.lit(n)) for n, rows in stages.items()]
    return tagged[0].unionByName(tagged[1]).join(best, "stage").withColumn("is_best", F.col("model") == F.col("best_model")).drop("best_model")


@query("ml_14_16_17_src_04_snk_03_04_final_model")
def _(s, d):
    """Result tables of all families are written and read again (one is missing), the best distinct candidate is built from its
    parameters, refitted on train and validation and scored once on test, for both targets; then it is fitted on all rows.  The
    manifest is written and read again."""
    train, valid, test = _split(s, d)
    mixtures = {k: models.FEATURE_MIXTURES[k] for k in ("current", "current_static_lag_lifecycle_material")}
    families = {"linear": {f"ridge_{a:g}": estimators.Ridge(a) for a in (0.01, 1.0, 100.0)} | {"linear": estimators.Linear()}, "trees": {k: v for k, v in models.estimators().items() if k in ("random_forest", "boosted_trees")}}
    paths = {n: tables.work_dir(s, "tuning") for n in (*families, "repeat", "missing")}
    for name, family in families.items():
        found = models.grid(train, valid, mixtures, "target_next_URA", family, ("direct", "delta"))
        tables.write_csv(found, paths[name])
        if name == "linear":
            tables.write_csv(found, paths["repeat"])
    candidates = models.distinct_candidates(tables.read_results(s, paths, models.RESULTS))
    best = models.chosen(candidates).first()
    make, features = estimators.from_json(best["params"]), mixtures[best["feature_mixture"]]
    both, everything, rows = train.unionByName(valid), train.unionByName(valid).unionByName(test), []
    for c in ("URA", "IRI"):
        final = models.fit(both, features, f"target_next_{c}", make, current=c, target_type=best["target_type"])
        production = models.fit(everything, features, f"target_next_{c}", make, current=c, target_type=best["target_type"])
        n, mae, rmse, r2 = models.evaluated(final, test).first()
        still = metrics.metrics(test, f"target_next_{c}", c).first()["rmse"]
        own = models.evaluated(production, everything).first()
        rows.append((f"target_next_{c}", best["model"], best["params"], best["target_type"], best["feature_mixture"], n, mae, rmse, r2, still, own["rows"], own["rmse"]))
    manifest = tables.work_dir(s, "manifest")
    tables.write_manifest(s, {"seed": 42, "best_model": best["model"], "candidates": candidates.count()}, manifest)
    told = tables.read_manifest(s, manifest).select("seed", "candidates")
    schema = "target string, model string, params string, target_type string, feature_mixture string, test_rows long, mae double, rmse double, r2 double, persistence_rmse double, production_rows long, production_rmse double"
    return s.createDataFrame(rows, schema).join(F.broadcast(told))


@query("ml_24_flt_08_band_ablation")
def _(s, d):
    """Mixture, target and model, trees among them, for each horizon of 1 to 4 years: errors in columns, persistence beside them.

    A horizon's rows are those with a measurement within three months of it, which is then their target.
    """
    split = _with_split(temporal.fixed_horizons(_table(s, d)), fx.parts(s, d))
    tried, found = {k: models.estimators()[k] for k in ("linear", "ridge", "boosted_trees")}, []
    for h in (1, 2, 3, 4):
        own = split.where(f"target_URA_{h}y is not null and target_IRI_{h}y is not null").withColumns(
            {"target_next_URA": F.col(f"target_URA_{h}y"), "target_next_IRI": F.col(f"target_IRI_{h}y"), "target_horizon_years": F.col(f"actual_horizon_years_{h}y")}
        )
        train, valid = (own.where(F.col("split") == n) for n in ("train", "validation"))
        found.append(models.grids(train, valid, models.FEATURE_MIXTURES, TARGETS, tried).withColumn("band", F.lit(f"h{h}y")))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("model", "target", "feature_mixture").pivot("band", [f"h{h}y" for h in (1, 2, 3, 4)]).agg(F.first("rmse").alias("rmse"), F.first("persistence_rmse").alias("persistence_rmse"), F.first("evaluation_rows").alias("rows"))


_PREDICTORS = {"persistence": "{c}", "previous": "prev_{c}"}


@query("rsh_05_union_of_results", f"WITH {SUP} " + " UNION ALL ".join(
    f"SELECT '{m}' AS model, 'target_next_{c}' AS target, count(*) AS rows, {rx(mae=f'avg(abs(target_next_{c} - {p.format(c=c)}))', rmse=f'sqrt(avg((target_next_{c} - {p.format(c=c)}) ** 2))')}{note} FROM sup WHERE {p.format(c=c)} IS NOT NULL"
    for m, p in _PREDICTORS.items() for c, note in (("URA", ", NULL AS note"), ("IRI", ", 'second target' AS note"))))
def _(s, d):
    """Result frames of both targets united by name; a column that one of them lacks is null there."""
    x = stored(fx.training(s, d).select("URA", "IRI", "prev_URA", "prev_IRI", "target_next_URA", "target_next_IRI"))
    frames = []
    for c in ("URA", "IRI"):
        long = metrics.unpivot_predictors(x, [], {m: (f"target_next_{c}", f"target_next_{c}", p.format(c=c)) for m, p in _PREDICTORS.items()})
        facts = {n: v for n, v in metrics.metric_columns(F.col("actual"), F.col("prediction")).items() if n != "r2"}
        found = long.groupBy("model", "target").agg(*(v.alias(n) for n, v in facts.items()))
        frames.append(found if c == "URA" else found.withColumn("note", F.lit("second target")).select("note", *found.columns))
    return frames[0].unionByName(frames[1], allowMissingColumns=True)


_MIXES = {"coarse": (0.0, 0.5, 1.0), "focused": (0.6, 0.7, 0.8, 0.9), "repeat": (0.5, 0.7)}
_STAGES = f"""WITH {SUP}, c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', CAST({w} AS DOUBLE))" for i, (n, ws) in enumerate(_MIXES.items()) for w in ws)}) t(stage_no, stage, share)),
g AS (SELECT stage_no, stage, share, count(*) AS rows, round(sqrt(avg((target_next_URA - share * URA - (1 - share) * prev_URA) ** 2)), 6) AS rmse FROM sup, c WHERE prev_URA IS NOT NULL GROUP BY ALL)"""


@query("ml_23_stage_progression", f"{_STAGES} SELECT stage, stage_no, '{{\"share\":' || share || '}}' AS params, rows, rmse FROM g QUALIFY row_number() OVER (PARTITION BY stage ORDER BY rmse, share) = 1")
def _(s, d):
    """The best candidate of each stage, from the stages' written result tables: mixtures of the current and the previous level."""
    x = stored(fx.training(s, d).where("prev_URA is not null").select("URA", "prev_URA", "target_next_URA"))
    paths = {}
    for name, shares in _MIXES.items():
        parts = F.explode(F.array(*map(F.lit, shares))).alias("share")
        mixed = x.select("*", parts).withColumn("prediction", F.col("share") * F.col("URA") + (1 - F.col("share")) * F.col("prev_URA"))
        found = mixed.groupBy("share").agg(*(c.alias(n) for n, c in metrics.metric_columns(F.col("target_next_URA"), F.col("prediction")).items() if n in ("rows", "rmse")))
        found = found.select(F.lit("mixture").alias("model"), F.lit("current").alias("feature_mixture"), F.to_json(F.struct("share")).alias("params"), "rows", F.round("rmse", 6).alias("rmse"))
        paths[name] = tables.work_dir(s, "stage")
        tables.write_csv(found, paths[name])
    read = tables.read_results(s, paths, "model string, feature_mixture string, params string, rows long, rmse double")
    stages = {n: read.where(F.col("source") == n).withColumn("feature_mixture", F.col("params")) for n in _MIXES}
    return models.progression(stages).select("stage", "stage_no", "params", "rows", "rmse")


@query("ml_10_random_forest_breakdown")
def _(s, d):
    train, valid, test = _split(s, d)
    fitted = models.fit(train.unionByName(valid), FULL, "target_next_URA", models.estimators()["random_forest"], target_type="delta")
    return metrics_by_sets(fitted.predict(test), [], ["ELY", "Toim_lk"], "target_next_URA", "prediction")


@query("ml_11_boosted_trees")
def _(s, d):
    """The published final candidate, with early stopping on a tenth of the assets: errors, persistence and the trees that were kept."""
    train, valid, _ = _split(s, d)
    fitted = models.fit(train, FULL, "target_next_URA", estimators.Boosted(0.10, 400, 127, 150, 0.10), target_type="delta")
    still = metrics.metrics(valid, "target_next_URA", "URA").first()["rmse"]
    return models.evaluated(fitted, valid).withColumns({"persistence_rmse": F.lit(still), "trees": F.lit(fitted.model.stages[-1].getNumTrees)})


@query("ml_18_19_weights")
def _(s, d):
    """Coefficients of a linear model and importances of a forest by encoded feature."""
    train, _, _ = _split(s, d)
    known, out = models.estimators(), []
    for name in ("linear", "random_forest"):
        out.append(models.weights(models.fit(train, FULL, "target_next_URA", known[name]), train).withColumn("model", F.lit(name)))
    return out[0].unionByName(out[1])


@query("ml_20_permutation_importance")
def _(s, d):
    """All features of the full mixture, five repeats, over all validation rows."""
    train, valid, _ = _split(s, d)
    fitted = models.fit(train, FULL, "target_next_URA", estimators.Boosted(0.10, 400, 127, 150, 0.10), target_type="delta")
    return models.permutation_importance(fitted, valid, FULL, ["Segment_ID", "slot_idx"])


@query("ml_21_joi_10_agg_40_response")
def _(s, d):
    """Heavy traffic set to each of its quantiles for up to 50,000 rows."""
    train, _, test = _split(s, d)
    fitted = models.fit(train, FULL, "target_next_URA", models.estimators()["linear"], target_type="delta")
    return models.response(fitted, test, "KVL_raskas", audit.quantile_grid(test, "KVL_raskas"), 50_000, ["Segment_ID", "slot_idx"])


@query("ml_22_encoding")
def _(s, d):
    train, valid, _ = _split(s, d)
    return models.encoded_row(models.fit(train, FULL, "target_next_URA", models.estimators()["linear"]), valid)


# Sinks and sources ----------------------------------------------------------------------------------------------------


@query("snk_01_02_layout_by_asset", f"WITH {HIST} SELECT Segment_ID, slot_idx, event_type, event_date, {r('URA')}, Event_Idx FROM hist")
def _(s, d):
    """The history written by asset and read again."""
    folder = tables.work_dir(s, "layout")
    tables.write_by_asset(fx.history(s, d), folder, buckets=max(16, fx.parts(s, d)))
    return s.read.parquet(folder).select("Segment_ID", "slot_idx", "event_type", "event_date", "URA", "Event_Idx")


@query("snk_02_bucketed_table", f"WITH {HIST} SELECT Segment_ID, count(*) AS n, max(Event_Idx) AS last FROM hist GROUP BY Segment_ID")
def _(s, d):
    """The history as a bucketed table; grouping by asset needs no exchange."""
    name = tables.work_dir(s, "history").rsplit("/", 1)[1].replace("-", "_")
    tables.save_bucketed(fx.history(s, d), name, buckets=max(8, fx.parts(s, d)))
    return s.table(name).groupBy("Segment_ID").agg(F.count("*").alias("n"), F.max("Event_Idx").alias("last"))


def _bucketed_events(s: SparkSession, d: str) -> DataFrame:
    name = tables.work_dir(s, "events").rsplit("/", 1)[1].replace("-", "_")
    tables.save_bucketed(fx.events(s, d), name, buckets=max(8, fx.parts(s, d)))
    return s.table(name)


@query("snk_02_history_from_buckets", f"WITH {HIST} SELECT Segment_ID, slot_idx, event_type, event_date, Event_Idx, cycle_num, Measurement_Idx, {r('URA', 'Pavement_Age_years')} FROM hist")
def _(s, d):
    """The whole history chain over a bucketed table of events: no exchange at all."""
    found = history.event_history(_bucketed_events(s, d), fx.TREATED_DROP, fx.UNTREATED_DROP)
    return found.select("Segment_ID", "slot_idx", "event_type", "event_date", "Event_Idx", "cycle_num", "Measurement_Idx", "URA", "Pavement_Age_years")


@query("snk_02_joi_11_asset_from_bucket", f"WITH {HIST} SELECT Segment_ID, Event_Idx, event_type, event_date, cycle_num FROM hist WHERE Segment_ID = '7'")
def _(s, d):
    """One asset's history, read from its bucket alone."""
    own = _bucketed_events(s, d).where("Segment_ID = '7'")
    return history.event_history(own, fx.TREATED_DROP, fx.UNTREATED_DROP).select("Segment_ID", "Event_Idx", "event_type", "event_date", "cycle_num")


@query("src_04_snk_03_result_tables", f"{_RES} SELECT ELY, Toim_lk, round(rmse, 4) AS rmse, n, 'first' AS source FROM res UNION ALL SELECT ELY, Toim_lk, round(rmse, 4), n, 'second' FROM res WHERE n > 5")
def _(s, d):
    """Result tables written as CSV and read again, tagged by their file; one that is missing is skipped."""
    paths = {n: tables.work_dir(s, "results") for n in ("first", "second", "missing")}
    found = _results(s, d)
    tables.write_csv(found, paths["first"])
    tables.write_csv(found.where("n > 5"), paths["second"])
    return tables.read_results(s, paths, "ELY string, Toim_lk string, rmse double, n long").withColumn("rmse", F.round("rmse", 4))


@query("snk_04_manifest", f"WITH {SUP} SELECT 42 AS seed, count(*) AS rows, count(DISTINCT Segment_ID) AS segments FROM sup")
def _(s, d):
    """Facts of the training table written as one JSON document and read again."""
    n, segments = fx.training(s, d).agg(F.count("*"), F.countDistinct("Segment_ID")).first()
    path = tables.work_dir(s, "manifest")
    tables.write_manifest(s, {"seed": 42, "rows": n, "segments": segments}, path)
    return tables.read_manifest(s, path).select(F.col("seed").cast("int").alias("seed"), "rows", "segments")


@query("snk_05_06_saved_model_scores")
def _(s, d):
    """A model saved and loaded, its scores of the test rows at a horizon of one year written and read again, beside those before saving."""
    train, _, test = _split(s, d)
    fitted = models.fit(train, CURRENT, "target_next_URA", models.estimators()["linear"])
    path, scores = tables.work_dir(s, "model"), tables.work_dir(s, "scores")
    tables.save_model(fitted.model, path)
    asked = test.withColumn("target_horizon_years", F.lit(1.0))
    tables.score(tables.load_model(path), models.prepared(asked, fitted.numeric, fitted.categories, fitted.fill), 1, scores)
    before = fitted.predict(asked).select("Segment_ID", "event_date", F.col("slot_idx"), F.col("prediction").alias("before_saving"))
    after = s.read.parquet(scores).select("Segment_ID", "event_date", "slot_idx", "forecast_horizon_years", "prediction")
    return after.join(before, ["Segment_ID", "event_date", "slot_idx"])

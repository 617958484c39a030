"""Regression pipelines on Spark ML: features, grids, delta targets, importance, counterfactuals."""

from __future__ import annotations

import math
import time
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.operators.history import ASSET
from wearline.operators.metrics import best_per_group, metric_columns, metrics
from wearline.operators.prefix import ranked
from wearline.operators.quantiles import quantiles
from wearline.operators.splits import exact_sample, rank_key
from wearline.plans import boost, forest
from wearline.plans.estimators import AT_ONCE, Boosted, Estimator, Forest, LeafModel, Linear, Ridge, to_json
from wearline.sources.tables import stored

# Cumulative feature mixtures.
FEATURE_MIXTURES = {
    "current": ["URA", "IRI", "target_horizon_years"],
    "current_static": ["URA", "IRI", "target_horizon_years", "KVL", "KVL_raskas", "KVL_kaista", "Nopeus", "Toim_lk"],
    "current_static_lag": ["URA", "IRI", "target_horizon_years", "KVL", "KVL_raskas", "KVL_kaista", "Nopeus", "Toim_lk", "prev_URA", "prev_IRI", "Delta_t_years"],
    "current_static_lag_lifecycle": [
        "URA", "IRI", "target_horizon_years", "KVL", "KVL_raskas", "KVL_kaista", "Nopeus", "Toim_lk", "prev_URA", "prev_IRI", "Delta_t_years",
        "observed_lifecycle_age_years", "Minor_TP_Count",
    ],
    "current_static_lag_lifecycle_material": [
        "URA", "IRI", "target_horizon_years", "KVL", "KVL_raskas", "KVL_kaista", "Nopeus", "Toim_lk", "prev_URA", "prev_IRI", "Delta_t_years",
        "observed_lifecycle_age_years", "Minor_TP_Count", "tp_count_interval", "surface_type_current", "material_type_current", "years_since_material_update",
    ],
}
CATEGORIES = ("Toim_lk", "surface_type_current", "material_type_current", "ELY")
# Columns that tell the target or the asset.
FORBIDDEN = (
    "target_next_URA", "target_next_IRI", "target_next_event_date", "target_next_measurement_idx", "baseline_persist_URA", "baseline_persist_IRI",
    "measurements_remaining_in_lifecycle", "has_next_measurement_in_lifecycle", "year", "Initial_URA", "Measurement_Idx", "has_TP_interval",
    "is_major_reset", "is_phantom_reset", "Tie", "Aosa", "Aet", "Losa", "Let", "ELY", "tp_surface_type", "tp_material_type",
)
# Candidates of the tuning stages as (learning rate, iterations, leaves, rows in a leaf, L2) and (trees, share of features, rows in a leaf).
BOOSTED_GRID = (
    (0.03, 650, 31, 50, 0.0), (0.05, 500, 31, 50, 0.0), (0.05, 500, 63, 50, 0.0), (0.05, 500, 63, 100, 0.01), (0.08, 350, 31, 50, 0.01), (0.08, 350, 63, 100, 0.05),
)
FOREST_GRID = ((250, "0.5", 5), (300, "0.7", 8), (350, "sqrt", 5))
FOCUSED_GRID = (
    (0.06, 500, 63, 100, 0.05), (0.08, 400, 63, 100, 0.05), (0.08, 500, 63, 100, 0.05), (0.10, 300, 63, 100, 0.05), (0.10, 400, 63, 100, 0.05),
    (0.12, 300, 63, 100, 0.05), (0.08, 350, 95, 100, 0.05), (0.08, 350, 127, 100, 0.05), (0.10, 350, 95, 100, 0.05), (0.10, 350, 127, 100, 0.05),
    (0.08, 350, 63, 75, 0.05), (0.08, 350, 63, 150, 0.05), (0.08, 350, 63, 200, 0.05), (0.08, 350, 63, 100, 0.03), (0.08, 350, 63, 100, 0.10),
    (0.08, 350, 63, 100, 0.20), (0.10, 400, 95, 150, 0.10), (0.10, 400, 127, 150, 0.10), (0.06, 650, 95, 150, 0.10), (0.12, 300, 95, 150, 0.10),
)


def bands(df: DataFrame, windows: Sequence[tuple[str, float, float]], days: str = "target_horizon_days") -> DataFrame:
    """A row for each band (name, first day, last day) that a row's horizon lies in, named in ``band``, by one pass."""
    inside = [F.when(F.col(days).between(first, last), name) for name, first, last in windows]
    return df.withColumn("band", F.explode(F.array_compact(F.array(*inside))))


def violations(columns: Sequence[str], features: Sequence[str]) -> list[tuple[str, str]]:
    """(feature, fault) of features that leak the target or do not exist."""
    return [(f, "leaks the target") for f in features if f in FORBIDDEN] + [(f, "missing") for f in features if f not in columns]


def empty_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without any value, by one pass."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if not counts[c]]


def medians(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact medians (mean of the middle two), fitted on the training rows only."""
    found = {r["column_name"]: r["median"] for r in quantiles(train, numeric, [0.5], written=True).select("column_name", F.col("q")[0].alias("median")).collect()} if numeric else {}
    return {c: found.get(c, 0.0) for c in numeric}


def modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    row = train.agg(*(F.mode(c, True).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns if row[c] is not None}


def prepared(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], fill: dict[str, float], category_fill: dict[str, str] | None = None) -> DataFrame:
    """Numeric features as doubles with the fitted fill, categories with ``missing`` or a fitted mode."""
    own = category_fill or {}
    return df.withColumns({
        **{f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in numeric},
        **{f"c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(own.get(c, "missing"))) for c in categories},
    })


def estimators() -> dict[str, Estimator]:
    """The four models of the grid."""
    return {"linear": Linear(), "ridge": Ridge(1.0), "random_forest": Forest(100, "0.5", 8), "boosted_trees": Boosted(0.08, 200, 31, 50)}


@dataclass
class Encoding:
    """Fills and category encoders of a set of features, fitted once on the training rows and shared by all fits on them."""

    numeric: list[str]
    categories: list[str]
    fill: dict[str, float]
    stages: list

    def rows(self, df: DataFrame) -> DataFrame:
        """``df`` with numeric features as ``x_`` and categories as ``o_`` columns."""
        return PipelineModel(self.stages).transform(prepared(df, self.numeric, self.categories, self.fill))

    def written(self, df: DataFrame) -> DataFrame:
        """The same from a written table, which all fits read.  The columns' names of values are metadata, which files lose."""
        rows = self.rows(df)
        kept = stored(rows)
        return kept.select(*(F.col(c).alias(c, metadata=rows.schema[c].metadata) if rows.schema[c].metadata else F.col(c) for c in rows.columns))


def encoding(train: DataFrame, features: Sequence[str]) -> Encoding:
    """Features without any value are dropped; unknown categories become the zero vector."""
    known = fills(train, features)
    numeric = [f for f in features if known.get(f) is not None]
    categories = [f for f in features if f in CATEGORIES and f not in known]
    stages = []
    if categories:
        x = prepared(train, [], categories, {})
        indexed = StringIndexer(inputCols=[f"c_{c}" for c in categories], outputCols=[f"i_{c}" for c in categories], handleInvalid="keep").fit(x)
        hot = OneHotEncoder(inputCols=[f"i_{c}" for c in categories], outputCols=[f"o_{c}" for c in categories]).fit(indexed.transform(x))
        stages = [indexed, hot]
    return Encoding(numeric, categories, {f: known[f] for f in numeric}, stages)


class Fitted:
    """A fitted pipeline with its fills; ``target_type`` is ``direct`` or ``delta``."""

    def __init__(self, model: PipelineModel, numeric, categories, fill, target: str, current: str, target_type: str) -> None:
        self.model, self.numeric, self.categories, self.fill = model, numeric, categories, fill
        self.target, self.current, self.target_type = target, current, target_type

    def level(self) -> Column:
        """The model's prediction as a level, whatever its target is."""
        return F.col("prediction") + F.col(self.current) if self.target_type == "delta" else F.col("prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` as a level."""
        out = self.model.transform(prepared(df, self.numeric, self.categories, self.fill))
        return out.withColumn("level", self.level()).select(*df.columns, F.col("level").alias("prediction"))

    def encoded_metrics(self, rows: DataFrame) -> DataFrame:
        """Errors over rows that are encoded already."""
        tail = [s for s in self.model.stages if not s.uid.startswith(("StringIndexer", "OneHotEncoder"))]
        return metrics(PipelineModel(tail).transform(rows).withColumn("level", self.level()), self.target, "level")


def fills(train: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Numeric features' medians and, for each feature without any value, null, by two passes over the training rows."""
    gone = set(empty_columns(train, features))
    numeric = [f for f in features if f not in CATEGORIES and f not in gone]
    return {**medians(train, numeric), **dict.fromkeys(gone)}


def _stops() -> Column:
    """Whether a row's asset is of those that tell a boosted fit to stop."""
    return F.substring(F.md5(F.concat_ws("|", F.lit("stop"), F.col(ASSET))), 1, 1).isin("0", "1")


def fit_encoded(rows: DataFrame, code: Encoding, features: Sequence[str], target: str, estimator: Estimator, *, current: str = "URA", target_type: str = "direct", scale: bool | None = None) -> Fitted:
    """Fits on rows that ``code`` has encoded, with those of its features that are named; ``scale`` overrides what the estimator asks for."""
    numeric, categories = ([f for f in of if f in features] for of in (code.numeric, code.categories))
    label = F.col(target) - F.col(current) if target_type == "delta" else F.col(target)
    x = rows.withColumn("label", label.cast("double")).where("label is not null")
    if estimator.stops:
        x = x.withColumn("stop", _stops())
    numbers = "numbers"
    stages = [VectorAssembler(inputCols=[f"x_{c}" for c in numeric], outputCol=numbers)]
    if estimator.scaled if scale is None else scale:
        n = x.count()
        stages += [
            StandardScaler(inputCol=numbers, outputCol="by_sample", withMean=True),
            # Spark divides by the sample's deviation; the population's is wanted
            ElementwiseProduct(inputCol="by_sample", outputCol="scaled", scalingVec=Vectors.dense([math.sqrt(n / (n - 1)) if n > 1 else 1.0] * len(numeric))),
        ]
        numbers = "scaled"
    stages.append(VectorAssembler(inputCols=[numbers, *(f"o_{c}" for c in categories)], outputCol="features"))
    vectors = Pipeline(stages=stages).fit(x)
    model = estimator.train(vectors.transform(x))
    return Fitted(PipelineModel([*code.stages, *vectors.stages, model]), code.numeric, code.categories, code.fill, target, current, target_type)


def fit(train: DataFrame, features: Sequence[str], target: str, estimator: Estimator, *, current: str = "URA", target_type: str = "direct", scale: bool | None = None) -> Fitted:
    """Encodes the training rows and fits on them; features that leak the target or do not exist are refused."""
    bad = violations(train.columns, features)
    if bad:
        raise ValueError(f"features can't be used: {bad}")
    code = encoding(train, features)
    return fit_encoded(code.rows(train), code, features, target, estimator, current=current, target_type=target_type, scale=scale)


def evaluated(fitted: Fitted, df: DataFrame) -> DataFrame:
    return metrics(fitted.predict(df), fitted.target, "prediction")


RESULTS = (
    "model string, target string, target_type string, feature_mixture string, split string, evaluation_rows long, mae double, rmse double, r2 double, "
    "persistence_rmse double, fit_seconds double, params string"
)


def grid(train: DataFrame, valid: DataFrame, mixtures: dict[str, Sequence[str]], target: str, models: dict[str, Estimator], target_types: Sequence[str] = ("direct",), current: str = "URA") -> DataFrame:
    """A result row per model, mixture and target type, equal parameters once, with the persistence of the same rows beside it."""
    return grids(train, valid, mixtures, {target: current}, models, target_types)


def grids(train: DataFrame, valid: DataFrame, mixtures: dict[str, Sequence[str]], targets: dict[str, str], models: dict[str, Estimator], target_types: Sequence[str] = ("direct",)) -> DataFrame:
    """The grids of several targets, each named with the column of its current level.

    The rows are encoded and written once.  Linear models of all mixtures come from one table of products, boosted ones are grown
    together, and so are forests, unless one task can't hold the different rows: then they are fitted up to ``AT_ONCE`` at the same time.
    """
    spark = train.sparkSession
    every = list(dict.fromkeys(f for features in mixtures.values() for f in features))
    bad = violations(train.columns, every)
    if bad:
        raise ValueError(f"features can't be used: {bad}")
    code = encoding(train, every)
    own, check = code.written(train), code.written(valid)
    still = {t: metrics(check, t, current).first()["rmse"] for t, current in targets.items()}
    tasks = {(t, to_json(e), m, k): (name, e) for name, e in reversed(models.items()) for t in targets for m in mixtures for k in target_types}

    def row(task: tuple, errors: Sequence, took: float) -> tuple:
        (target, params, mixture, kind), (name, _) = task
        return (name, target, kind, mixture, "validation", *errors, still[target], took, params)

    def run(task: tuple) -> tuple:
        (target, _, mixture, kind), (_, estimator) = task
        began = time.time()
        fitted = fit_encoded(own, code, mixtures[mixture], target, estimator, current=targets[target], target_type=kind)
        took = time.time() - began
        return row(task, fitted.encoded_metrics(check).first(), took)

    rows, others = [], []
    for kinds, errors in ((Linear | Ridge, line_errors), (Boosted, boosted_errors), (Forest, forest_errors)):
        own_tasks = [t for t in tasks.items() if isinstance(t[1][1], kinds)]
        if own_tasks:
            asked = [(target, targets[target], kind, mixtures[mixture], estimator) for (target, _, mixture, kind), (_, estimator) in own_tasks]
            found = errors(own, check, code, asked)
            if found is None:
                others += own_tasks
            else:
                rows += [row(t, *own_found) for t, own_found in zip(own_tasks, found, strict=True)]
    if others:
        with ThreadPool(min(AT_ONCE, len(others))) as pool:
            rows += pool.map(inheritable_thread_target(spark)(run), others, chunksize=1)
    return spark.createDataFrame(rows, RESULTS)


def products(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of centred products of the columns of ``v``; all zero with fewer than two rows."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("v"), "v"))
    n = matrix.numRows()
    if n < 2:
        width = matrix.numCols() if n else 0
        return n, np.array(vectors.first()["v"].toArray() if n else []), np.zeros((width, width))
    return n, matrix.computeColumnSummaryStatistics().mean(), matrix.computeCovariance().toArray() * (n - 1)


def solved(n: int, xx: np.ndarray, xy: np.ndarray, numbers: np.ndarray, alpha: float) -> np.ndarray:
    """Weights on unscaled columns of least squares with ``alpha * |w|^2`` on the columns as fits scale them: ``numbers`` have deviation 1.

    Without a penalty it is the shortest solution, as the columns of a category add up to the intercept's.
    """
    deviation = np.sqrt(np.maximum(np.diag(xx), 0) / n)
    scale = np.where(numbers, np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0), 1.0)
    a, b = xx * np.outer(scale, scale), xy * scale
    if alpha:
        return scale * np.linalg.solve(a + alpha * np.eye(len(a)), b)
    values, vectors = np.linalg.eigh(a)
    kept = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return scale * (vectors[:, kept] @ ((vectors[:, kept].T @ b) / values[kept]))


def line_errors(rows: DataFrame, check: DataFrame, code: Encoding, asked: Sequence[tuple[str, str, str, Sequence[str], Linear | Ridge]]) -> list[tuple[tuple, float]]:
    """Errors over ``check`` and seconds of linear fits on encoded rows, each (target, current level, target type, features, estimator).

    All features and labels are multiplied with each other once, which is all that least squares needs of the rows; labels that
    lack values on some rows have a table of products each.  All fits are scored by one pass.  Shared seconds are divided evenly.
    """
    began = time.time()
    parts, owner = _places(code)
    numbers = np.arange(len(owner)) < len(code.numeric)
    labels = _labels(asked)
    every = rows.agg(F.count("*"), *(F.count(c) for c in labels.values())).first()
    whole = [k for k, n in zip(labels, every[1:], strict=True) if n == every[0]]
    found: dict[tuple[str, str], tuple] = {}
    for group in ([whole] if whole else []) + [[k] for k in labels if k not in whole]:
        named = {f"_y{i}": labels[k] for i, k in enumerate(group)}
        own = rows.withColumns(named).na.drop(subset=list(named))
        n, mean, xx = products(VectorAssembler(inputCols=[*parts, *named], outputCol="v").transform(own))
        if not n:
            raise ValueError(f"no rows with a label: {group}")
        found |= {k: (n, mean[: len(owner)], mean[len(owner) + i], xx[: len(owner), : len(owner)], xx[: len(owner), len(owner) + i]) for i, k in enumerate(group)}
    weight, start = np.zeros((len(owner), len(asked))), np.zeros(len(asked))
    for i, (t, _, kind, features, estimator) in enumerate(asked):
        n, x, y, xx, xy = found[t, kind]
        at = np.flatnonzero(np.isin(owner, list(features)))
        weight[at, i] = solved(n, xx[np.ix_(at, at)], xy[at], numbers[at], getattr(estimator, "alpha", 0.0))
        start[i] = y - x @ weight[:, i]
    took = (time.time() - began) / len(asked)

    @F.arrow_udf("array<double>")
    def predicted(x: pa.Array) -> pa.Array:
        own = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(weight))
        out = own @ weight + start
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(start)), pa.array(out.ravel()))

    scored = VectorAssembler(inputCols=parts, outputCol="v").transform(check).withColumn("_p", predicted(vector_to_array("v")))
    return _errors(scored, asked, took)


def boosted_errors(rows: DataFrame, check: DataFrame, code: Encoding, asked: Sequence[tuple[str, str, str, Sequence[str], Boosted]]) -> list[tuple[tuple, float]]:
    """Errors over ``check`` and seconds of boosted fits on encoded rows, asked for as in ``line_errors``; all are grown together."""
    began = time.time()
    parts, owner = _places(code)
    labels = _labels(asked)
    number = {k: i for i, k in enumerate(labels)}
    fits = [boost.Fit(number[t, kind], np.flatnonzero(np.isin(owner, list(features))), estimator) for t, _, kind, features, estimator in asked]
    vectors = VectorAssembler(inputCols=parts, outputCol="features")
    bounds = boost.boosted(vectors.transform(rows.withColumns({**{f"y{i}": labels[k] for k, i in number.items()}, "stop": _stops()})), len(labels), fits)
    took = (time.time() - began) / len(asked)
    levels = list(dict.fromkeys(c for t, current, *_ in asked for c in (t, current)))
    return _errors(boost.predicted(vectors.transform(check), bounds, fits, levels), asked, took)


def forest_errors(rows: DataFrame, check: DataFrame, code: Encoding, asked: Sequence[tuple[str, str, str, Sequence[str], Forest]]) -> list[tuple[tuple, float]] | None:
    """Errors over ``check`` and seconds of forests on encoded rows, asked for as in ``line_errors``; none, if one task can't hold the different rows."""
    began = time.time()
    parts, owner = _places(code)
    labels = _labels(asked)
    number = {k: f"y{i}" for i, k in enumerate(labels)}
    fits = [(number[t, kind], np.flatnonzero(np.isin(owner, list(features))).tolist(), e.trees, e.share, e.leaf_rows, t, current if kind == "delta" else None) for t, current, kind, features, e in asked]
    levels = list(dict.fromkeys(c for *_, actual, added in fits for c in (actual, added) if c))
    vectors = VectorAssembler(inputCols=parts, outputCol="features")
    found = forest.together(vectors.transform(rows.withColumns({n: labels[k] for k, n in number.items()})), vectors.transform(check), list(number.values()), levels, fits)
    return None if found is None else [(errors, (time.time() - began) / len(asked)) for errors in found]


def _places(code: Encoding) -> tuple[list[str], np.ndarray]:
    """Columns of the encoded vector and, for each of its places, the feature."""
    sizes = dict(zip(code.categories, (size - 1 for size in code.stages[1].categorySizes), strict=True)) if code.categories else {}
    return [*(f"x_{c}" for c in code.numeric), *(f"o_{c}" for c in code.categories)], np.array([*code.numeric, *(c for c in code.categories for _ in range(sizes[c]))])


def _labels(asked: Sequence[tuple]) -> dict[tuple[str, str], Column]:
    """The labels asked for by target and target type."""
    return {(t, kind): (F.col(t) - F.col(current) if kind == "delta" else F.col(t)).cast("double") for t, current, kind, *_ in asked}


def _errors(scored: DataFrame, asked: Sequence[tuple], took: float) -> list[tuple[tuple, float]]:
    """Errors of all fits from rows with their predictions in the array ``_p``, by one pass."""
    each = [
        F.struct(F.lit(i).alias("fit"), F.col(t).cast("double").alias("actual"), (F.get("_p", F.lit(i)) + (F.col(current) if kind == "delta" else F.lit(0.0))).alias("prediction"))
        for i, (t, current, kind, _, _) in enumerate(asked)
    ]
    facts = metric_columns(F.col("actual"), F.col("prediction"))
    errors = {r["fit"]: tuple(r)[1:] for r in scored.select(F.inline(F.array(*each))).groupBy("fit").agg(*(c.alias(name) for name, c in facts.items())).collect()}
    return [(errors.get(i, (0, None, None, None)), took) for i in range(len(asked))]


def distinct_candidates(results: DataFrame) -> DataFrame:
    """One row per candidate: target, target type, mixture and canonical parameters, whatever its name; of repeats the best."""
    w = Window.partitionBy("target", "target_type", "feature_mixture", "params").orderBy("rmse", "model")
    return results.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def chosen(results: DataFrame) -> DataFrame:
    return best_per_group(results, ["target"], "rmse", ["model", "target_type", "feature_mixture"])


def progression(stages: dict[str, DataFrame]) -> DataFrame:
    """The best row of each tuning stage, in order."""
    out = None
    for i, (name, results) in enumerate(stages.items()):
        best = best_per_group(results, [], "rmse", ["model", "feature_mixture"]).withColumns({"stage": F.lit(name), "stage_no": F.lit(i)})
        out = best if out is None else out.unionByName(best)
    return out


def feature_names(fitted: Fitted, df: DataFrame) -> list[str]:
    """Names of the encoded vector's places."""
    meta = PipelineModel(fitted.model.stages[:-1]).transform(prepared(df, fitted.numeric, fitted.categories, fitted.fill)).schema["features"].metadata
    named = [a for group in meta.get("ml_attr", {}).get("attrs", {}).values() for a in group]
    names = {a["idx"]: a["name"] for a in named}
    for i, c in enumerate(fitted.numeric):
        names[i] = c
    return [names.get(i, f"f{i}") for i in range(max(names) + 1)]


def weights(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Coefficients or importances by encoded feature, strongest first."""
    model = fitted.model.stages[-1]
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    rows = [(n, float(v)) for n, v in zip(feature_names(fitted, df), values.toArray(), strict=False)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature")


def permutation_importance(fitted: Fitted, df: DataFrame, features: Sequence[str], key: Sequence[str], repeats: int = 5) -> DataFrame:
    """Increase of RMSE when a feature's values are dealt anew among all rows: mean and deviation over the repeats.

    For each repeat the rows are ranked by md5 (in ranges, so no task sorts them all) and each takes the values of the one before,
    the first those of the last.  Every feature and repeat is scored in one job.  Only what the model reads is kept of the rows, encoded
    once; boosted trees score the exchanged values in arrays, a tree again only where it asks for the feature.
    """
    asked = list(dict.fromkeys([*fitted.numeric, *fitted.categories, *features, fitted.target, fitted.current, *key]))
    rows = stored(df.select(*asked))
    base = evaluated(fitted, rows).first()["rmse"]
    boosted = isinstance(fitted.model.stages[-1], LeafModel)
    if boosted:
        heads = [s for s in fitted.model.stages if s.uid.startswith(("StringIndexer", "OneHotEncoder"))]
        coded = PipelineModel(heads).transform(prepared(rows, fitted.numeric, fitted.categories, fitted.fill))
        given_columns = [*(f"x_{c}" for c in fitted.numeric), *(f"i_{c}" for c in fitted.categories)]
        level = F.col(fitted.current).cast("double") if fitted.target_type == "delta" else F.lit(0.0)
        rows = stored(coded.select(*key, *(F.col(c).cast("double") for c in given_columns), F.col(fitted.target).cast("double").alias("_actual"), level.alias("_level")))
    parts = []
    for k in range(repeats):
        placed = stored(ranked(rows, [], [rank_key(1000 + k, *key), *key], "_rank"))
        given = placed.select((F.col("_rank") % F.col("total__rank") + 1).alias("_rank"), F.struct(*([*given_columns, "_level"] if boosted else features)).alias("_given"))
        parts.append(placed.join(given, "_rank").drop("_rank", "total__rank").withColumn("_repeat", F.lit(k)))
    exchanged = reduce(DataFrame.unionByName, parts)
    if boosted:
        per = _exchanged_errors(fitted, heads, exchanged.select("_repeat", "_actual", "_level", *given_columns, *(F.col(f"_given.{c}").alias(f"_given_{c}") for c in [*given_columns, "_level"])), features)
    else:
        dealt = exchanged.withColumn("_feature", F.explode(F.array(*map(F.lit, features))))
        dealt = dealt.withColumns({f: F.when(F.col("_feature") == f, F.col(f"_given.{f}")).otherwise(F.col(f)) for f in features}).drop("_given")
        scored = fitted.predict(dealt)
        per = scored.groupBy(F.col("_feature").alias("feature"), "_repeat").agg(metric_columns(F.col(fitted.target), F.col("prediction"))["rmse"].alias("rmse"))
    return per.groupBy("feature").agg(F.avg(F.col("rmse") - base).alias("rmse_increase"), F.stddev_pop("rmse").alias("std"))


def _exchanged_errors(fitted: Fitted, heads: Sequence, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """RMSE by feature and repeat of boosted trees when the feature's values are the given ones."""
    model = fitted.model.stages[-1]
    trees, start = model.arrays(rows.sparkSession), model.base
    sizes = [size - 1 for size in heads[1].categorySizes] if heads else []
    names, categories, current = fitted.numeric, fitted.categories, fitted.current
    firsts = [len(names) + sum(sizes[:i]) for i in range(len(sizes))]
    places = {**{c: [i] for i, c in enumerate(names)}, **{c: list(range(at, at + size)) for c, at, size in zip(categories, firsts, sizes, strict=True)}}
    reading = {f: [t for t in trees if np.isin(t.feature, places.get(f, [])).any()] for f in features}

    def vectors(b: pa.RecordBatch, prefix: str) -> np.ndarray:
        out = np.zeros((b.num_rows, len(names) + sum(sizes)))
        for i, c in enumerate(names):
            out[:, i] = b.column(f"{prefix}x_{c}").to_numpy(zero_copy_only=False)
        for c, at, size in zip(categories, firsts, sizes, strict=True):
            code = b.column(f"{prefix}i_{c}").to_numpy(zero_copy_only=False).astype(int)
            known = np.flatnonzero(code < size)
            out[known, at + code[known]] = 1.0
        return out

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], np.ndarray] = defaultdict(lambda: np.zeros(2))
        for b in batches:
            own, given = vectors(b, ""), vectors(b, "_given_")
            repeat = b.column("_repeat").to_numpy()
            actual, level, other = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_actual", "_level", "_given__level"))
            said = {id(t): t.values(own) for t in trees}
            rest = actual - start - sum(said.values())
            for f in features:
                e = rest - (other if f == current else level)
                if reading[f]:
                    at = places[f]
                    kept = own[:, at].copy()
                    own[:, at] = given[:, at]
                    e = e - sum(t.values(own) - said[id(t)] for t in reading[f])
                    own[:, at] = kept
                both = ~np.isnan(e)
                for k in np.unique(repeat):
                    mine = both & (repeat == k)
                    found[f, int(k)] += mine.sum(), (e[mine] ** 2).sum()
        if found:
            (f, k), v = zip(*found, strict=True), np.array(list(found.values()))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(f, pa.string()), "_repeat": pa.array(k, pa.int32()), "n": pa.array(v[:, 0]), "s": pa.array(v[:, 1])})

    each = rows.mapInArrow(sums, "feature string, _repeat int, n double, s double")
    return each.groupBy("feature", "_repeat").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"))


def response(fitted: Fitted, df: DataFrame, feature: str, grid_values: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """What the model says when ``feature`` is set to each grid value, over up to ``n`` rows that have it (a stated sample).

    Means of the raw prediction, of the level and of the change from the current level, and the change's 10 and 90 percent
    quantiles.  Rows are encoded once; only the feature's place in the encoded row is exchanged.
    """
    sample = exact_sample(df.where(F.col(feature).isNotNull()), n, seed, *key)
    heads = [s for s in fitted.model.stages if s.uid.startswith(("StringIndexer", "OneHotEncoder"))]
    tail = PipelineModel(fitted.model.stages[len(heads) :])
    encoded = stored(PipelineModel(heads).transform(prepared(sample, fitted.numeric, fitted.categories, fitted.fill)))
    values = grid_values.select(F.col(grid_values.columns[0]).cast("double").alias("grid_value"))
    exchanged = encoded.join(F.broadcast(values)).withColumn(f"x_{feature}", F.col("grid_value"))
    out = tail.transform(exchanged).withColumn("level", fitted.level()).withColumn("change", F.col("level") - F.col(fitted.current))
    out = stored(out.select("grid_value", "prediction", "level", "change"))
    ends = quantiles(out, ["change"], [0.1, 0.9], ["grid_value"], written=True).select("grid_value", F.col("q")[0].alias("p10_change"), F.col("q")[1].alias("p90_change"))
    return out.groupBy("grid_value").agg(F.avg("prediction").alias("mean_raw"), F.avg("level").alias("mean_level"), F.avg("change").alias("mean_change"), F.count("*").alias("rows")).join(ends, "grid_value")


def scaling(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per numeric feature the mean and the population's deviation after the fills, over the training rows."""
    known = fills(train, features)
    numeric = [f for f in features if known.get(f) is not None]
    x = prepared(train, numeric, [], {f: known[f] for f in numeric})
    facts = [F.struct(F.lit(c).alias("feature"), F.avg(f"x_{c}").alias("mean"), F.stddev_pop(f"x_{c}").alias("deviation")) for c in numeric]
    return x.agg(F.array(*facts).alias("a")).select(F.inline("a"))


def encoded_row(fitted: Fitted, df: DataFrame) -> DataFrame:
    """One row's encoded vector by feature."""
    names = feature_names(fitted, df)
    x = fitted.model.transform(prepared(df, fitted.numeric, fitted.categories, fitted.fill)).limit(1).select(F.posexplode(vector_to_array("features")).alias("i", "encoded"))
    table = F.array(*map(F.lit, names))
    return x.select(F.get(table, "i").alias("feature"), "encoded")

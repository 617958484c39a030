"""Estimators by their stated parameters, kept as canonical JSON and built again from it.

Each one trains on rows with ``features`` and ``label`` (and ``stop`` for early stopping) and gives a
transformer that adds ``prediction``.
"""

from __future__ import annotations

import json
import math
import threading
from collections import defaultdict
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.plans import forest
from wearline.sources.tables import stored, work_dir

#: A boosted model stops when its own tenth of the assets gains less than this.
STOP_GAIN = 0.001
#: Trees of a forest that are grown as one Spark model, and models that are grown at the same time.
PART, AT_ONCE = 10, 8
_fits = threading.BoundedSemaphore(AT_ONCE)
#: Trees after which the prediction so far is written and no longer added up anew.
BLOCK = 25


@dataclass(frozen=True)
class Linear:
    """Least squares."""

    scaled = True
    stops = False

    def train(self, rows: DataFrame) -> Model:
        return LinearRegression(regParam=0.0).fit(rows)


@dataclass(frozen=True)
class Ridge:
    """Ridge with penalty ``alpha * |w|^2`` on the sum of squares; Spark ML's unit of it depends on the label that is fitted."""

    alpha: float = 1.0
    scaled = True
    stops = False

    def train(self, rows: DataFrame) -> Model:
        n, sd = rows.agg(F.count("label"), F.stddev_pop("label")).first()
        return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=self.alpha * (sd or 1.0) / max(n, 1)).fit(rows)


@dataclass(frozen=True)
class Forest:
    """A random forest as deep as Spark allows (30 levels), grown in parts side by side; on more than ``forest.FEW_ROWS`` rows by ``forest``.

    Deep forests of Spark ML are bound by the driver, which picks the splits of all nodes of a level; parts of ``PART`` trees with
    seeds of their own are the same forest and pick theirs at the same time.
    """

    trees: int
    share: str
    leaf_rows: int
    scaled = False
    stops = False

    def train(self, rows: DataFrame) -> Model:
        if rows.count() > forest.FEW_ROWS:
            with _fits:
                return forest.forest(rows, self.trees, self.share, self.leaf_rows)

        def part(i: int) -> Model:
            own = RandomForestRegressor(
                numTrees=min(PART, self.trees - i * PART), maxDepth=30, minInstancesPerNode=self.leaf_rows, featureSubsetStrategy=self.share, seed=42 + i, cacheNodeIds=True, checkpointInterval=-1
            )
            with _fits:
                return own.fit(rows)

        count = -(-self.trees // PART)
        with ThreadPool(min(AT_ONCE, count)) as pool:
            return ForestModel(pool.map(inheritable_thread_target(rows.sparkSession)(part), range(count), chunksize=1))


class ForestModel(Model):
    """The mean over the trees of all parts."""

    def __init__(self, parts: list[Model]) -> None:
        super().__init__()
        self.parts = parts

    @property
    def getNumTrees(self) -> int:  # noqa: N802 (Spark ML's name)
        return sum(p.getNumTrees for p in self.parts)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(sum(p.featureImportances.toArray() * p.getNumTrees for p in self.parts) / self.getNumTrees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, p in enumerate(self.parts):
            own = p.copy()
            out = own.setPredictionCol(f"_part_{i}").transform(out)
        total = sum((F.col(f"_part_{i}") * F.lit(float(p.getNumTrees)) for i, p in enumerate(self.parts)), F.lit(0.0))
        return out.withColumn("prediction", total / self.getNumTrees).drop(*(f"_part_{i}" for i in range(len(self.parts))))


@dataclass(frozen=True)
class Boosted:
    """Boosted trees with early stopping, a limit of leaves and L2.

    Spark grows the trees by level without L2; ``refitted`` then keeps each tree's best splits up to ``leaves`` leaves and gives
    every leaf the value ``rate * sum(residual) / (rows + l2)`` in the order of the trees.  Spark's step is half of the stated
    rate, as it fits twice the residual.
    """

    rate: float
    iterations: int
    leaves: int
    leaf_rows: int
    l2: float = 0.0
    scaled = False
    stops = True

    def train(self, rows: DataFrame) -> Model:
        tall = GBTRegressor(
            maxIter=self.iterations, stepSize=self.rate / 2, maxDepth=math.ceil(math.log2(self.leaves)), minInstancesPerNode=self.leaf_rows, seed=42,
            validationIndicatorCol="stop", validationTol=STOP_GAIN,
        )
        with _fits:
            grown = tall.fit(rows)
        return refitted(grown, rows.where("not stop"), self.rate, self.leaves, self.l2)


KINDS = {"linear": Linear, "ridge": Ridge, "random_forest": Forest, "boosted_trees": Boosted}
Estimator = Linear | Ridge | Forest | Boosted


def to_json(estimator: Estimator) -> str:
    """Kind and parameters in one fixed form, so that equal estimators have equal texts."""
    kind = next(k for k, cls in KINDS.items() if type(estimator) is cls)
    return json.dumps({"kind": kind, **asdict(estimator)}, sort_keys=True)


def from_json(text: str) -> Estimator:
    """The estimator that ``to_json`` wrote."""
    params = json.loads(text)
    return KINDS[params.pop("kind")](**params)


# Boosted trees with refitted leaves -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    gain: float
    left: int
    right: int


def grown_nodes(model: GBTRegressionModel, spark) -> list[dict[int, Node]]:
    """Each tree's nodes, as Spark writes them; the size is bounded by the model's."""
    path = work_dir(spark, "trees")
    model.write().overwrite().save(path)
    trees: dict[int, dict[int, Node]] = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.gain", "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild").toLocalIterator():
        trees[r["treeID"]][r["id"]] = Node(r["gain"] * r["rawCount"], r["leftChild"], r["rightChild"])
    return [trees[t] for t in sorted(trees)]


def kept_leaves(nodes: dict[int, Node], leaves: int) -> list[int]:
    """For each leaf in Spark's order (from the left) the node that stands for it when only the best splits are made.

    Splits are made best first by what they gain over all rows, a child after its parent, until there are ``leaves`` leaves.
    """
    open_nodes, made = [0], set()
    while len(made) < leaves - 1:
        able = [i for i in open_nodes if nodes[i].left >= 0]
        if not able:
            break
        best = max(able, key=lambda i: (nodes[i].gain, -i))
        made.add(best)
        open_nodes.remove(best)
        open_nodes += [nodes[best].left, nodes[best].right]
    out: list[int] = []

    def walk(i: int, owner: int | None) -> None:
        owner = i if owner is None and i not in made else owner
        if nodes[i].left < 0:
            out.append(owner)
        else:
            walk(nodes[i].left, owner)
            walk(nodes[i].right, owner)

    walk(0, None)
    return out


def _added(start: Column, values: Column, leaf: Column, first: int, last: int) -> Column:
    """``start`` and the values of the row's leaves in trees ``first`` to ``last - 1``."""
    if first == last:
        return start
    return F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), start, lambda acc, t: acc + F.get(F.get(values, t), F.get(leaf, t)))


def _table(spark, values: list[list[float]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(values,)], "_values array<array<double>>"))


@dataclass(frozen=True)
class LeafTree:
    """A tree's nodes: feature (-1: leaf), bound, whether rows up to it go right, children and value."""

    feature: np.ndarray
    bound: np.ndarray
    turned: np.ndarray
    children: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, nodes: dict[int, tuple], leaves: list[float]) -> LeafTree:
        """From Spark's nodes; a feature of two categories is one with a bound between them, and of more there are none."""
        n = max(nodes) + 1
        own = cls(np.full(n, -1), np.zeros(n), np.zeros(n, bool), np.zeros((n, 2), int), np.zeros(n))
        values, todo = iter(leaves), [0]
        while todo:
            i = todo.pop()
            left, right, feature, lefts, categories = nodes[i]
            if left < 0:
                own.value[i] = next(values)
                continue
            if categories > 2:
                raise ValueError(f"feature {feature} has {categories} categories")
            own.feature[i], own.children[i] = feature, (left, right)
            own.bound[i], own.turned[i] = (lefts[0], False) if categories < 0 else (0.5, lefts[0] == 1.0)
            todo += [right, left]
        return own

    def values(self, x: np.ndarray) -> np.ndarray:
        """What the tree says of each row."""
        at = np.zeros(len(x), int)
        inner = np.arange(len(x)) if self.feature[0] >= 0 else np.empty(0, int)
        while len(inner):
            node = at[inner]
            at[inner] = self.children[node, ((x[inner, self.feature[node]] > self.bound[node]) ^ self.turned[node]).astype(int)]
            inner = inner[self.feature[at[inner]] >= 0]
        return self.value[at]


class LeafModel(Model):
    """A mean and each tree's leaf values."""

    def __init__(self, trees: GBTRegressionModel, base: float, values: list[list[float]]) -> None:
        super().__init__()
        self.trees, self.base, self.values = trees, base, values

    @property
    def getNumTrees(self) -> int:  # noqa: N802 (Spark ML's name)
        return len(self.values)

    @property
    def featureImportances(self):  # noqa: N802
        return self.trees.featureImportances

    def arrays(self, spark) -> list[LeafTree]:
        """The trees for rows in arrays."""
        path = work_dir(spark, "trees")
        self.trees.write().overwrite().save(path)
        found: dict[int, dict[int, tuple]] = defaultdict(dict)
        split = ("nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")
        for t, i, *node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", *split).toLocalIterator():
            found[t][i] = tuple(node)
        return [LeafTree.of(found[t], own) for t, own in zip(sorted(found), self.values, strict=True)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = with_leaves(self.trees, dataset).join(_table(dataset.sparkSession, self.values))
        return found.withColumn("prediction", _added(F.lit(self.base), F.col("_values"), F.col("_leaf"), 0, len(self.values))).drop("_values", "_leaf")


def with_leaves(trees: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds ``_leaf``: each tree's leaf number."""
    own = trees.copy()
    own.setLeafCol("_leaves").setPredictionCol("_grown")
    return own.transform(rows).withColumn("_leaf", vector_to_array("_leaves").cast("array<int>")).drop("_leaves", "_grown")


def refitted(trees: GBTRegressionModel, rows: DataFrame, rate: float, leaves: int, l2: float) -> LeafModel:
    """Leaf values from sums of residuals over the training rows, tree by tree; the first tree counts whole, as in Spark."""
    spark = rows.sparkSession
    owners = [kept_leaves(nodes, leaves) for nodes in grown_nodes(trees, spark)]
    base = rows.agg(F.avg("label")).first()[0]
    member = stored(with_leaves(trees, rows).select("label", "_leaf", F.lit(base).alias("_f")))
    values: list[list[float]] = []
    done = 0
    for t, owner in enumerate(owners):
        if t - done == BLOCK:
            member = stored(member.join(_table(spark, values)).withColumn("_f", _added(F.col("_f"), F.col("_values"), F.col("_leaf"), done, t)).drop("_values"))
            done = t
        so_far = member.join(_table(spark, values)) if values else member
        level = _added(F.col("_f"), F.col("_values"), F.col("_leaf"), done, t) if values else F.col("_f")
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0])
        for r in so_far.groupBy(F.get("_leaf", F.lit(t)).alias("leaf")).agg(F.sum(F.col("label") - level).alias("s"), F.count("*").alias("n")).toLocalIterator():
            sums[owner[r["leaf"]]][0] += r["s"]
            sums[owner[r["leaf"]]][1] += r["n"]
        step = rate if t else 1.0
        values.append([step * sums[o][0] / (sums[o][1] + l2) if sums[o][1] else 0.0 for o in owner])
    return LeafModel(trees, base, values)

"""Boosted trees of several fits at once: each pass over the rows serves one level of the trees that all fits are growing.

Spark ML fits one model at a time with several passes a level, each of which reads and assembles all rows.  Here the rows' bins are
written once, equal rows as one with their number, a pass sums the residuals of all fits by node and bin, and one more pass a round tells the leaves' values and the error
on the rows that stop a fit.  The rules are those of ``Boosted``: grown trees are added as Spark does and stop by its rule; the values
that count are refitted with L2 over each tree's best leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.plans.estimators import BLOCK, STOP_GAIN, Boosted, Node, kept_leaves
from wearline.plans.forest import PASS_NODES, _matrix, binned, bounds_of, choose, counted, entries, tables, walk
from wearline.sources.tables import stored


@dataclass
class Tree:
    """Nodes as arrays: feature (-1: leaf), last bin on the left, left child, gain, grown value, refitted value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    refit: np.ndarray

    @classmethod
    def root(cls) -> Tree:
        return cls(np.array([-1]), np.array([0]), np.array([0]), np.zeros(1), np.zeros(1), np.zeros(1))

    def split(self, node: int, feature: int, cut: int, gain: float, values: Sequence[float]) -> list[int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, first, gain
        self.feature = np.append(self.feature, [-1, -1])
        self.cut, self.left = (np.append(a, [0, 0]) for a in (self.cut, self.left))
        self.gain, self.refit = (np.append(a, [0.0, 0.0]) for a in (self.gain, self.refit))
        self.value = np.append(self.value, values)
        return [first, first + 1]

    def leaves(self) -> list[int]:
        """Leaves from the left."""
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            if self.feature[i] < 0:
                out.append(i)
            else:
                todo += [int(self.left[i]) + 1, int(self.left[i])]
        return out

    def settle(self, sums: dict[int, tuple[float, float]], step: float, leaves: int, l2: float) -> None:
        """Refitted values from each leaf's rows and sum of residuals, over the best ``leaves`` leaves."""
        inner = self.feature >= 0
        nodes = {i: Node(float(self.gain[i]), int(self.left[i]) if inner[i] else -1, int(self.left[i]) + 1 if inner[i] else -1) for i in range(len(self.feature))}
        own, owners = self.leaves(), kept_leaves(nodes, leaves)
        total: dict[int, np.ndarray] = {}
        for leaf, owner in zip(own, owners, strict=True):
            total[owner] = total.get(owner, np.zeros(2)) + sums.get(leaf, (0.0, 0.0))
        for leaf, owner in zip(own, owners, strict=True):
            n, s = total[owner]
            self.refit[leaf] = step * s / (n + l2) if n else 0.0

    def at(self, x: np.ndarray) -> np.ndarray:
        return walk(x, self.feature, self.cut, self.left)


@dataclass
class Fit:
    """A fit's label (a number), places of its features, parameters, and what has been grown."""

    label: int
    places: np.ndarray
    spec: Boosted
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    kept: int = 1
    error: float = math.inf
    open: bool = True

    @property
    def depth(self) -> int:
        return math.ceil(math.log2(self.spec.leaves))


def _start(batch: pa.RecordBatch, fits: list[Fit]) -> np.ndarray:
    """(row, fit, grown and refitted) levels as last written."""
    if "f" in batch.schema.names:
        return np.frombuffer(b"".join(batch.column("f").to_pylist())).reshape(batch.num_rows, len(fits), 2)
    return np.broadcast_to(np.array([[0.0, f.base] for f in fits]), (batch.num_rows, len(fits), 2))


def _added(x: np.ndarray, start: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    """Levels (row, grown and refitted) after ``trees``."""
    out = np.array(start)
    for tree in trees:
        leaf = tree.at(x)
        out[:, 0] += tree.value[leaf]
        out[:, 1] += tree.refit[leaf]
    return out


def _recent(fits: list[Fit], done: int) -> list[Fit]:
    """The fits with the trees that are not in the written levels; only these are sent to tasks."""
    return [replace(f, trees=f.trees[done:]) for f in fits]


def _read(batch: pa.RecordBatch, labels: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Bins, labels (NaN: none), whether a row stops fits, and the number of equal rows."""
    y = [batch.column(f"y{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(labels)]
    return _matrix(batch, "x"), y, batch.column("stop").to_numpy(zero_copy_only=False).astype(bool), batch.column("n").to_numpy().astype(float)


def _best(own: DataFrame, labels: int, fits: list[Fit], now: list[tuple[int, int]], sizes: np.ndarray) -> DataFrame:
    """For each (fit, node) of the trees being grown, the last of each fit: rows, sum and the best split, by one pass."""
    asked = [(fits[i].places, fits[i].spec.leaf_rows) for i, _ in now]
    slots: dict[int, np.ndarray] = {}
    for k, (i, node) in enumerate(now):
        slots.setdefault(i, np.full(len(fits[i].trees[-1].feature), -1))[node] = k

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(now), int(sizes.sum())))
        for b in batches:
            x, y, stop, n = _read(b, labels)
            start, (row, place) = _start(b, fits), entries(x, sizes)
            for i, slot in slots.items():
                fit = fits[i]
                at = slot[fit.trees[-1].at(x)]
                rest = y[fit.label] - _added(x, start[:, i], fit.trees[:-1])[:, 0]
                kept = (at >= 0) & ~stop & ~np.isnan(rest)
                if kept.any():
                    used, mine = np.unique(at[kept], return_inverse=True)
                    inside = kept[row]
                    total[:, used] += tables(mine, (np.cumsum(kept) - 1)[row[inside]], place[inside], rest[kept], n[kept], len(used), sizes)
        for k in np.flatnonzero(total[0].any(axis=1)):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([k], pa.int32()), "table": pa.array([total[:, k].tobytes()], pa.binary())})

    first = np.cumsum(sizes) - sizes

    def best(found: pd.DataFrame) -> pd.DataFrame:
        k = int(found["slot"].iloc[0])
        places, least = asked[k]
        table = sum(np.frombuffer(b).reshape(2, 1, -1) for b in found["table"])
        n, s = table[:, 0, : sizes[0]].sum(axis=1)
        bins = np.concatenate([np.arange(first[p], first[p] + sizes[p]) for p in places])
        f, cut, gain, _ = (v[0] for v in choose(table[:, :, bins], sizes[places], least, len(places), np.random.default_rng(0)))
        f = int(places[f]) if f >= 0 else -1
        left_n, left_s = table[:, 0, first[f] : first[f] + int(cut) + 1].sum(axis=1) if f >= 0 else (0.0, 0.0)
        return pd.DataFrame([(k, f, int(cut), float(gain), float(n), float(s), float(left_n), float(left_s))], columns=["slot", "feature", "cut", "gain", "n", "s", "ln", "ls"])

    return own.mapInArrow(sums, "slot int, table binary").groupBy("slot").applyInPandas(best, "slot int, feature int, cut int, gain double, n double, s double, ln double, ls double")


def _settled(own: DataFrame, labels: int, fits: list[Fit], active: list[int]) -> DataFrame:
    """For each fit and leaf of its last tree the rows and sum of what is left to refit; as leaf -1 the stopping rows and their squared error."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {i: np.zeros((2, len(fits[i].trees[-1].feature) + 1)) for i in active}
        for b in batches:
            x, y, stop, n = _read(b, labels)
            start = _start(b, fits)
            for i in active:
                fit = fits[i]
                tree, level, label = fit.trees[-1], _added(x, start[:, i], fit.trees[:-1]), y[fit.label]
                leaf = tree.at(x)
                learn, test = ~stop & ~np.isnan(label), stop & ~np.isnan(label)
                out[i][0, :-1] += np.bincount(leaf[learn], n[learn], len(tree.feature))
                out[i][1, :-1] += np.bincount(leaf[learn], (n * (label - level[:, 1]))[learn], len(tree.feature))
                out[i][:, -1] += n[test].sum(), (n * (label - level[:, 0] - tree.value[leaf]) ** 2)[test].sum()
        for i, own in out.items():
            used = np.flatnonzero(own[0])
            leaf = np.where(used == own.shape[1] - 1, -1, used)
            yield pa.RecordBatch.from_pydict({"fit": pa.array(np.full(len(used), i), pa.int32()), "leaf": pa.array(leaf, pa.int32()), "n": pa.array(own[0, used]), "s": pa.array(own[1, used])})

    return own.mapInArrow(sums, "fit int, leaf int, n double, s double").groupBy("fit", "leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _written(own: DataFrame, fits: list[Fit]) -> DataFrame:
    """The rows with all fits' levels so far, so that later passes add up a block of trees only."""
    names = [c for c in own.columns if c != "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, start = _matrix(b, "x"), _start(b, fits)
            level = np.stack([_added(x, start[:, i], f.trees) for i, f in enumerate(fits)], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([r.tobytes() for r in level], pa.binary())], [*names, "f"])

    return stored(own.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in own.dtypes if c != "f") + ", f binary"))


def boosted(rows: DataFrame, labels: int, fits: list[Fit]) -> list[np.ndarray]:
    """Grows all fits on rows with ``features``, ``y0``, ``y1``, ... and ``stop``; gives the bounds of the features' bins."""
    learned = rows.where("not stop")
    bounds = bounds_of(learned)
    sizes = np.array([len(b) + 1 for b in bounds])
    means = learned.agg(*(F.avg(f"y{i}") for i in range(labels))).first()
    for f in fits:
        if means[f.label] is None:
            raise ValueError("no rows with a label")
        f.base = means[f.label]
    keys = [*(f"y{i}" for i in range(labels)), "stop"]
    own, done, count = counted(binned(rows, bounds, keys), [*keys, "x"]), 0, 0
    while active := [i for i, f in enumerate(fits) if f.open]:
        if count - done == BLOCK:
            own, done = _written(own, _recent(fits, done)), count
        step = [f.spec.rate if count else 1.0 for f in fits]
        for i in active:
            fits[i].trees.append(Tree.root())
        wanted = [(i, 0) for i in active]
        for level in range(max(fits[i].depth for i in active) + 1):
            now, wanted = wanted, []
            for k in range(0, len(now), PASS_NODES):
                part = now[k : k + PASS_NODES]
                for slot, feature, cut, gain, n, s, left_n, left_s in _best(own, labels, _recent(fits, done), part, sizes).collect():
                    i, node = part[slot]
                    tree = fits[i].trees[-1]
                    if not level:
                        tree.value[0] = step[i] * s / n
                    if feature >= 0 and level < fits[i].depth:
                        children = tree.split(node, feature, cut, gain, [step[i] * left_s / left_n, step[i] * (s - left_s) / (n - left_n)])
                        wanted += [(i, c) for c in children if level + 1 < fits[i].depth]
            if not wanted:
                break
        sums: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in active}
        for i, leaf, n, s in _settled(own, labels, _recent(fits, done), active).collect():
            sums[i][leaf] = (n, s)
        count += 1
        for i in active:
            f = fits[i]
            f.trees[-1].settle(sums[i], step[i], f.spec.leaves, f.spec.l2)
            n, s = sums[i].get(-1, (0.0, 0.0))
            error = s / n if n else math.inf
            if count == 1:
                f.error, f.open = error, n > 0
            elif f.error - error < STOP_GAIN * max(error, 0.01):
                f.open = False
            elif error < f.error:
                f.error, f.kept = error, count
            f.open = f.open and count < f.spec.iterations
    for f in fits:
        del f.trees[f.kept :]
    return bounds


def predicted(rows: DataFrame, bounds: list[np.ndarray], fits: list[Fit], columns: list[str]) -> DataFrame:
    """``columns`` of rows with ``features``, and every fit's prediction in the array ``_p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "x")
            out = np.stack([_added(x, np.tile([0.0, f.base], (len(x), 1)), f.trees)[:, 1] for f in fits], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fits)), pa.array(out.ravel()))], [*columns, "_p"])

    return binned(rows, bounds, columns).mapInArrow(run, ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns) + ", _p array<double>")

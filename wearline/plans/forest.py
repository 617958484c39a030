"""Deep forests on many rows: the top of all trees level by level over all rows, then each part of a tree in a task of its own.

Rows that are equal in all bins and labels are one row with their number: its copies in a bag are a Poisson draw with that mean, as
the sum of their own draws would be.  With at most ``PART_ROWS`` of them every task has them all and grows whole trees.

Otherwise, as Spark ML sends a table of bins for each node and partition at every level, however few rows a node has, that is done
only until a node has at most ``PART_ROWS`` rows of its tree's bag; then the bag's rows are dealt by tree and node, once, and the rest
of the tree below that node is grown beside them.  Trees stay tables, as they have about as many nodes as a tree has rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.sources.tables import stored

#: Rows up to which Spark ML grows a forest; different rows (of a node: of its tree's bag) that one task holds; nodes whose tables of bins one pass holds.
FEW_ROWS, PART_ROWS, PASS_NODES = 5_000, 500_000, 2048
#: Bins of a feature, and rows that their bounds are taken from (as in Spark ML).
BINS, BOUND_ROWS = 32, 10_000
DEPTH = 30
#: Cells of the tables of bins that a tree's nodes are split by at once, and their rows.
SLOT_CELLS, SLOT_ROWS = 128_000, 16_000


@functools.cache
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """A number of copies, and the shares of draws with at most that many, one more, ...; what lies outside is less than a double tells."""
    reach = 12 * math.sqrt(mean) + 20
    k = np.arange(max(0, math.floor(mean - reach)), math.ceil(mean + reach) + 1)
    logs = math.lgamma(k[0] + 1) + np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return int(k[0]), np.cumsum(np.exp(k * math.log(mean) - mean - logs))


def copies(ids: np.ndarray, tree: int, numbers: np.ndarray) -> np.ndarray:
    """How often each row is in the tree's bag (Poisson with the row's number as mean), by a hash of both."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((42 + tree) * 0xD1B54A32D192ED03 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    draw, order = (z >> np.uint64(11)) / 2.0**53, np.argsort(numbers, kind="stable")
    out, starts = np.empty(len(ids), np.int64), np.flatnonzero(np.diff(numbers[order], prepend=-1))
    for own in np.split(order, starts[1:]) if len(ids) else ():
        least, shares = _poisson(int(numbers[own[0]]))
        out[own] = least + np.searchsorted(shares[:-1], draw[own], side="right")
    return out


def entries(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place among all features' bins of each entry that is not in its feature's first bin; categories have few of them."""
    row, f = np.nonzero(x)
    return row, (np.cumsum(sizes) - sizes)[f] + x[row, f]


def tables(slot: np.ndarray, row: np.ndarray, place: np.ndarray, y: np.ndarray, w: np.ndarray, slots: int, sizes: np.ndarray) -> np.ndarray:
    """Rows and sums of the label by slot, feature and bin: an array (2, slots, bins of all features).  First bins are what the others leave."""
    total, first = int(sizes.sum()), np.cumsum(sizes) - sizes
    key = slot[row] * total + place
    out = np.empty((2, slots, total))
    for own, v in zip(out, (w, w * y), strict=True):
        own[:] = np.bincount(key, v[row], slots * total).reshape(slots, total)
        own[:, first] = np.bincount(slot, v, slots)[:, None] - np.add.reduceat(own, first, axis=1)
    return out


def choose(table: np.ndarray, sizes: np.ndarray, least: int, features: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each slot the best split by squared error among ``features`` random features: feature (-1: none), last bin on the left, gain, rows on the left."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    run = np.cumsum(table, axis=2)
    before = np.concatenate([np.zeros((2, table.shape[1], 1)), run[:, :, ends[:-1] - 1]], axis=2)
    (n, s), (left, part) = run[:, :, ends[0] - 1, None], run - before[:, :, owner]
    able = np.argsort(np.argsort(rng.random((table.shape[1], len(sizes))))) < features
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = part**2 / left + (s - part) ** 2 / (n - left) - s**2 / n
    gain = np.where((left >= least) & (n - left >= least) & able[:, owner], gain, -1.0)
    best = gain.argmax(axis=1)
    at = np.arange(len(best))
    found = gain[at, best] > 1e-9 * np.maximum(1.0, np.abs(s[:, 0]))
    return np.where(found, owner[best], -1), best - (ends - sizes)[owner[best]], gain[at, best], left[at, best]


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Each row's leaf: on the left of a split if its bin is at most ``cut``; the right child follows the left one."""
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        node = at[inner]
        at[inner] = left[node] + (x[inner, feature[node]] > cut[node])
        inner = inner[feature[at[inner]] >= 0]
    return at


def bundled(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's place among all features' bins by column; neighbours of two bins of which a row is in one second bin at most, as those of a category, share a column."""
    first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    columns, used = [], None
    for f in np.flatnonzero(sizes > 1):
        if sizes[f] > 2:
            columns.append(first[f] + x[:, f].astype(np.int64))
            continue
        on = x[:, f] > 0
        if used is None or (used & on).any():
            used = np.zeros(len(x), bool)
            columns.append(np.full(len(x), total))
            shared = columns[-1]
        shared[on] = first[f] + 1
        used |= on
    return (np.stack(columns, axis=1) if columns else np.full((len(x), 1), total)).astype(np.uint16 if total < 2**16 else np.int32)


def _filled(places: np.ndarray, rows: np.ndarray, slot: np.ndarray, w: np.ndarray, wy: np.ndarray, slots: int, total: int) -> np.ndarray:
    """Rows and sums of the label by place and slot: an array (2, ``total`` + 1, slots) from ``bundled`` places."""
    found, columns = np.zeros((2, (total + 1) * slots)), places.shape[1]
    for k in range(0, len(rows), SLOT_ROWS):
        part = slice(k, k + SLOT_ROWS)
        keys = places[rows[part]].astype(np.int64)
        keys *= slots
        keys += slot[part, None]
        for own, v in zip(found, (w, wy), strict=True):
            own += np.bincount(keys.ravel(), np.repeat(v[part], columns), len(own))
    return found.reshape(2, total + 1, slots)


class Cuts:
    """``choose`` on tables of ``_filled``, in the same memory for all slots of a tree."""

    def __init__(self, sizes: np.ndarray, least: int, features: int, slots: int) -> None:
        self.sizes, self.least, self.features = sizes, least, features
        self.first, inner = np.cumsum(sizes) - sizes, sizes - 1  # the last bin of a feature is no cut
        self.start = np.cumsum(inner) - inner
        self.owner = np.repeat(np.arange(len(sizes)), inner)
        self.bin = np.arange(len(self.owner)) - self.start[self.owner]
        self.two, self.more = np.flatnonzero(sizes == 2), np.flatnonzero(sizes > 2)
        self.sums = {k: np.tril(np.ones((k - 1, k - 1))) for k in set(sizes[self.more].tolist())}
        self.numbers, self.flags = np.empty((4, len(self.owner) * slots)), np.empty((2, len(self.owner) * slots), bool)

    def best(self, table: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the table, and the rows and sums ``n`` of each slot: feature (-1: none), last bin on the left, gain."""
        cuts, slots = len(self.owner), table.shape[2]
        if not cuts:
            return np.full(slots, -1), np.zeros(slots, int), np.zeros(slots)
        left, part, right, other = (own[: cuts * slots].reshape(cuts, slots) for own in self.numbers)
        able, flag = (own[: cuts * slots].reshape(cuts, slots) for own in self.flags)
        for of, to, whole in zip(table, (left, part), n, strict=True):
            for f in self.more:
                k = self.sizes[f] - 1
                np.matmul(self.sums[k + 1], of[self.first[f] : self.first[f] + k], out=to[self.start[f] : self.start[f] + k])
            to[self.start[self.two]] = whole - of[self.first[self.two] + 1]
        np.subtract(n[0], left, out=right)
        np.greater_equal(left, self.least, out=able)
        able &= np.greater_equal(right, self.least, out=flag)
        if self.features < len(self.sizes):
            drawn = rng.random((slots, len(self.sizes)))
            among = drawn <= np.partition(drawn, self.features - 1, axis=1)[:, self.features - 1, None]
            able &= np.take(np.ascontiguousarray(among.T), self.owner, axis=0, out=flag)
        part -= np.multiply(left, n[1] / n[0], out=other)  # from the slot's mean
        part *= part
        left *= right
        part /= np.maximum(left, 1e-200, out=left)
        part *= able
        best = part.max(axis=0)
        at = np.equal(part, best, out=flag).argmax(axis=0)
        gain = best * n[0]
        return np.where(gain > 1e-9 * np.maximum(1.0, np.abs(n[1])), self.owner[at], -1), self.bin[at], gain


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: np.ndarray, depth: int, least: int, features: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree on these rows, level by level: feature (-1: leaf), cut, left child and mean label of each node, and each feature's gain."""
    return _grown(x, bundled(x, sizes), w, w * y, sizes, depth, least, features, rng)


def _grown(x: np.ndarray, places: np.ndarray, w: np.ndarray, wy: np.ndarray, sizes: np.ndarray, depth: int, least: int, features: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """The same from weights, sums of the label and places of ``bundled``.

    Rows stay sorted by their node, and few nodes are split at a time, so that their tables stay in a core's cache.
    """
    at_once = max(1, SLOT_CELLS // int(sizes.sum()))
    cuts = Cuts(sizes, least, features, at_once)
    rows = np.flatnonzero(w)
    feature, cut, left, value = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([wy.sum() / w.sum()])]
    gains, count = np.zeros(len(sizes)), 1
    able, start = np.array([0]), np.array([0, len(rows)])  # nodes of the last level that may be split, and where their rows begin
    for _ in range(depth):
        level = [[], [], []]  # value of the children, those that may be split, and the rows of these
        sizes_of = []
        nodes = next_k = 0
        while (k := next_k) < len(able):
            next_k = max(k + 1, min(k + at_once, len(able), int(np.searchsorted(start, start[k] + SLOT_ROWS, side="right")) - 1))
            ends = start[k : next_k + 1]
            own = rows[ends[0] : ends[-1]]
            slots = len(ends) - 1
            slot = np.repeat(np.arange(slots), np.diff(ends))
            v, vy = w[own], wy[own]
            whole = np.stack([np.bincount(slot, of, slots) for of in (v, vy)])
            f, c, g = cuts.best(_filled(places, own, slot, v, vy, slots, int(sizes.sum())), whole, rng)
            made = np.flatnonzero(f >= 0)
            if not len(made):
                continue
            np.add.at(gains, f[made], g[made])
            at = able[k:next_k][made]
            feature[-1][at], cut[-1][at], left[-1][at] = f[made], c[made], count + nodes + 2 * np.arange(len(made))
            rank = np.full(slots, -1)
            rank[made] = np.arange(len(made))
            split = rank[slot] >= 0
            own, slot, v, vy = own[split], slot[split], v[split], vy[split]
            child = 2 * rank[slot] + (x[own, f[slot]] > c[slot])
            n, s = (np.bincount(child, of, 2 * len(made)) for of in (v, vy))
            level[0].append(s / n)
            again = n >= 2 * least  # the others are leaves
            kept = again[child]
            own, child = own[kept], child[kept]
            order = np.argsort(child.astype(np.uint16) if 2 * slots < 2**16 else child, kind="stable")
            level[1].append(nodes + np.flatnonzero(again))
            level[2].append(own[order])
            sizes_of.append(np.bincount(child, minlength=2 * len(made))[again])
            nodes += 2 * len(made)
        if not nodes:
            break
        count += nodes
        for of, new in ((feature, np.full(nodes, -1)), (cut, np.zeros(nodes, int)), (left, np.zeros(nodes, int)), (value, np.concatenate(level[0]))):
            of.append(new)
        able, rows = np.concatenate(level[1]), np.concatenate(level[2])
        start = np.concatenate([[0], np.cumsum(np.concatenate(sizes_of))])
    return (*(np.concatenate(v) for v in (feature, cut, left, value)), gains)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _bins(vectors: pa.Array, bounds: list[np.ndarray]) -> np.ndarray:
    v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(bounds))
    return np.stack([np.searchsorted(own, v[:, i], side="left") for i, own in enumerate(bounds)], axis=1).astype(np.uint8)


def binned(rows: DataFrame, bounds: list[np.ndarray], columns: list[str]) -> DataFrame:
    """``columns`` and the features' bins, a byte each, in ``x``."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([r.tobytes() for r in _bins(b.column("_v"), bounds)], pa.binary())], [*columns, "x"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns)
    return rows.select(*columns, vector_to_array("features").alias("_v")).mapInArrow(bins, f"{kinds}, x binary")


def bounds_of(rows: DataFrame) -> list[np.ndarray]:
    """Bounds of each feature's bins: between all values, if there are few, else at even places of about ``BOUND_ROWS`` rows."""
    n = rows.count()
    some = rows.select(vector_to_array("features").alias("v"))
    some = some.sample(min(1.0, 1.2 * BOUND_ROWS / n), seed=42) if n > BOUND_ROWS else some
    v = np.array([r["v"] for r in some.collect()])
    out = []
    for c in v.T:
        values = np.unique(c)
        if len(values) > BINS:
            values = np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="inverted_cdf"))
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


class Top:
    """The first nodes of all trees, as arrays; ``least`` rows in a leaf."""

    def __init__(self, trees: int) -> None:
        self.nodes = [[np.array([k]) for k in (-1, 0, 0, 0)] for _ in range(trees)]  # feature, cut, left child, depth
        self.gains: list[dict[int, float]] = [{} for _ in range(trees)]

    def split(self, tree: int, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        f, c, left, depth = self.nodes[tree]
        first = len(f)
        f[node], c[node], left[node] = feature, cut, first
        self.nodes[tree] = [np.append(f, [-1, -1]), np.append(c, [0, 0]), np.append(left, [0, 0]), np.append(depth, [depth[node] + 1] * 2)]
        self.gains[tree][feature] = self.gains[tree].get(feature, 0.0) + gain
        return first, first + 1


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The different rows, written, with their number ``n`` and an ``id`` that is a hash of them; they are dealt by number, as few bytes are much work here."""
    total = rows.count()
    tasks = max(min(2 * rows.sparkSession.sparkContext.defaultParallelism, 1 + total // 2_000), total // 500_000)
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return stored(each.withColumn("id", F.xxhash64(*keys)).repartition(tasks))


def drawn_features(share: str, places: int) -> int:
    """How many of a vector's places a split may choose from."""
    return {"all": places, "sqrt": math.ceil(math.sqrt(places))}.get(share) or max(1, math.ceil(float(share) * places))


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each different row, and each row's number among these."""
    code = np.random.default_rng(0).integers(1, 2**63, x.shape[1], np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        key = x.astype(np.uint64) @ code
    _, at, number = np.unique(key, return_index=True, return_inverse=True)
    if not np.array_equal(x[at][number], x):
        _, at, number = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return at, number.ravel()


class Table:
    """Different rows as arrays: bins, numbers, ids and named columns (NaN: no value)."""

    def __init__(self, own: DataFrame, names: list[str], places: int) -> None:
        found = own.toArrow()
        self.x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.uint8).reshape(-1, places)
        self.n, self.ids = (found.column(c).to_numpy() for c in ("n", "id"))
        self.columns = {c: np.asarray(found.column(c).to_numpy(), float) for c in names}


class View:
    """The different rows of some places of a table, each with its ``bundled`` places, and every row's number among them."""

    def __init__(self, table: Table, at: np.ndarray, sizes: np.ndarray) -> None:
        first, self.number = grouped(table.x[:, at])
        self.x, self.sizes = np.ascontiguousarray(table.x[np.ix_(first, at)]), sizes[at]
        self.places = bundled(self.x, self.sizes)

    def tree(self, table: Table, label: str, tree: int, least: int, features: int) -> tuple[np.ndarray, ...]:
        y = table.columns[label]
        known = ~np.isnan(y)
        w = np.where(known, copies(table.ids, tree, table.n), 0)
        w = w if w.any() else np.where(known, table.n, 0)
        w, wy = (np.bincount(self.number, v, len(self.x)) for v in (w, w * np.where(known, y, 0.0)))
        return _grown(self.x, self.places, w, wy, self.sizes, DEPTH, least, features, np.random.default_rng([43, tree]))


def forest(rows: DataFrame, trees: int, share: str, least: int) -> DeepForest:
    """A forest on rows with ``features`` and ``label``."""
    bounds = bounds_of(rows)
    sizes = np.array([len(b) + 1 for b in bounds])
    features = drawn_features(share, len(bounds))
    own = counted(binned(rows.select("features", F.col("label").cast("double").alias("label")), bounds, ["label"]), ["label", "x"])
    n, top = own.count(), Top(trees)
    if n <= PART_ROWS:
        return DeepForest(bounds, top, stored(_whole(own, sizes, trees, least, features)), trees)
    large = [(t, 0) for t in range(trees)]
    while large:
        now, large = large[:PASS_NODES], large[PASS_NODES:]
        for t, node, f, c, gain, left, right in _best(own, top.nodes, now, sizes, least, features).collect():
            if f >= 0:
                children = top.split(t, node, f, c, gain)
                large += [(t, k) for k, size in zip(children, (left, right), strict=True) if size > PART_ROWS and top.nodes[t][3][k] < DEPTH]
    # by a number, as few bytes are much work here
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, n * trees // 500_000)
    return DeepForest(bounds, top, stored(_parts(own, top, sizes, least, features, tasks)), tasks)


_PART = "tree int, node int, feature array<int>, cut array<int>, left array<long>, value array<double>, gains array<double>"


def _whole(own: DataFrame, sizes: np.ndarray, trees: int, least: int, features: int) -> DataFrame:
    """All trees whole, each in a task that has all rows."""
    spark = own.sparkSession
    table = Table(own, ["label"], len(sizes))
    given = spark.sparkContext.broadcast((table, View(table, np.arange(len(sizes)), sizes)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("id").to_pylist():
                table, view = given.value
                made = zip(("feature", "cut", "left", "value", "gains"), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), view.tree(table, "label", t, least, features), strict=True)
                lists = {name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for name, kind, v in made}
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([0], pa.int32()), **lists})

    return spark.range(0, trees, 1, max(1, min(trees, trees * len(table.x) // 50_000))).mapInArrow(grow, _PART)


def together(rows: DataFrame, check: DataFrame, labels: list[str], levels: list[str], fits: list[tuple]) -> list[tuple] | None:
    """Errors over ``check`` of several forests on rows with ``features`` and ``labels``, grown and scored side by side; none, if a task can't hold the rows.

    A fit is (label, places, trees, share, least rows in a leaf, actual level, level to add or none).  A task grows some trees of a fit and adds up
    what they say of the different rows of ``check``; trees are not kept.
    """
    spark = rows.sparkSession
    bounds = bounds_of(rows)
    sizes = np.array([len(b) + 1 for b in bounds])
    own, other = (counted(binned(of.select("features", *(F.col(c).cast("double").alias(c) for c in names)), bounds, names), [*names, "x"]) for of, names in ((rows, labels), (check, levels)))
    if own.count() > PART_ROWS or other.count() > PART_ROWS:
        return None
    table, asked = Table(own, labels, len(sizes)), Table(other, levels, len(sizes))
    if any(np.isnan(table.columns[label]).all() for label, *_ in fits):
        raise ValueError("no rows with a label")
    send = spark.sparkContext.broadcast
    views = {places: send((View(table, np.array(places), sizes), View(asked, np.array(places), sizes))) for places in {tuple(f[1]) for f in fits}}
    given, facts = send(table), send((asked.n, asked.columns))
    each = max(1, 50_000 // max(1, len(table.x)))
    jobs = [(i, range(k, f[2], per)) for i, f in enumerate(fits) for per in [max(1, min(32, f[2] // each))] for k in range(per)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in b.column("id").to_pylist():
                i, numbers = jobs[job]
                label, places, _, share, least, *_ = fits[i]
                view, on = views[tuple(places)].value
                total = np.zeros(len(on.x))
                for t in numbers:
                    *tree, value, _ = view.tree(given.value, label, t, least, drawn_features(share, len(places)))
                    total += value[walk(on.x, *tree)]
                yield pa.RecordBatch.from_pydict({"fit": pa.array([i], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def errors(found: pd.DataFrame) -> pd.DataFrame:
        i = int(found["fit"].iloc[0])
        _, places, trees, _, _, actual, added = fits[i]
        n, columns = facts.value
        said = (sum(np.frombuffer(b) for b in found["total"]) / trees)[views[tuple(places)].value[1].number]
        e = columns[actual] - (said + columns[added] if added else said)
        both = ~np.isnan(e)
        n, y, e = n[both], columns[actual][both], e[both]
        rows, sse = int(n.sum()), float((n * e * e).sum())
        spread = float((n * (y - (n * y).sum() / rows) ** 2).sum()) if rows else 0.0
        r2 = None if rows < 2 else 1 - sse / spread if spread > 0 else float(sse == 0)
        return pd.DataFrame([(i, rows, float((n * np.abs(e)).sum()) / rows if rows else None, math.sqrt(sse / rows) if rows else None, r2)], columns=["fit", "rows", "mae", "rmse", "r2"])

    told = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(grow, "fit int, total binary").groupBy("fit").applyInPandas(errors, "fit int, rows long, mae double, rmse double, r2 double")
    by_fit = {r["fit"]: tuple(r)[1:] for r in told.collect()}
    return [by_fit[i] for i in range(len(fits))]


def _best(own: DataFrame, nodes: list, now: list[tuple[int, int]], sizes: np.ndarray, least: int, features: int) -> DataFrame:
    """The best split of each of the named nodes, by one pass over all rows."""
    slots: dict[int, np.ndarray] = {}
    for i, (t, node) in enumerate(now):
        slots.setdefault(t, np.full(len(nodes[t][0]), -1))[node] = i

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(now), int(sizes.sum())))
        for b in batches:
            x, y, ids, numbers = _matrix(b, "x"), *(b.column(c).to_numpy() for c in ("label", "id", "n"))
            row, place = entries(x, sizes)
            for t, slot in slots.items():
                w = copies(ids, t, numbers)
                at = slot[walk(x, *nodes[t][:3])]
                kept = (w > 0) & (at >= 0)
                if kept.any():
                    used, own = np.unique(at[kept], return_inverse=True)
                    inside = kept[row]
                    total[:, used] += tables(own, (np.cumsum(kept) - 1)[row[inside]], place[inside], y[kept], w[kept], len(used), sizes)
        for i in np.flatnonzero(total[0].any(axis=1)):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([i], pa.int32()), "table": pa.array([total[:, i].tobytes()], pa.binary())})

    def best(found: pd.DataFrame) -> pd.DataFrame:
        i = int(found["slot"].iloc[0])
        table = sum(np.frombuffer(b).reshape(2, 1, -1) for b in found["table"])
        f, c, gain, left = choose(table, sizes, least, features, np.random.default_rng([42, *now[i]]))
        n = table[0, 0, : sizes[0]].sum()
        return pd.DataFrame([(*now[i], int(f[0]), int(c[0]), float(gain[0]), int(left[0]), int(n - left[0]))], columns=["tree", "node", "feature", "cut", "gain", "lefts", "rights"])

    return own.mapInArrow(sums, "slot int, table binary").groupBy("slot").applyInPandas(best, "tree int, node int, feature int, cut int, gain double, lefts long, rights long")


def _dealt(own: DataFrame, nodes: list, bagged: bool) -> DataFrame:
    """Each row once for every tree (those in its bag alone, with their copies ``w``), with the node of the tree's top that it comes to."""
    columns = ["label"] if bagged else ["id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b, "x"), b.column("id").to_numpy()
            for t, node in enumerate(nodes):
                w = copies(ids, t, b.column("n").to_numpy()) if bagged else np.ones(len(ids), np.int64)
                kept = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept), t, np.int32)), pa.array(walk(x[kept], *node[:3]).astype(np.int32)), pa.array(w[kept].astype(np.int32)), *(b.column(c).take(pa.array(kept)) for c in (*columns, "x"))],
                    ["tree", "node", "w", *columns, "x"],
                )

    return own.mapInArrow(deal, f"tree int, node int, w int, {'label double' if bagged else 'id long'}, x binary")


def _parts(own: DataFrame, top: Top, sizes: np.ndarray, least: int, features: int, tasks: int) -> DataFrame:
    """What stands below each last node of the trees' tops, grown beside that node's rows."""
    nodes = top.nodes

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        t, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        x = np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(len(rows), -1)
        made = grown(x, rows["label"].to_numpy(), rows["w"].to_numpy().astype(float), sizes, DEPTH - int(nodes[t][3][node]), least, features, np.random.default_rng([43, t, node]))
        return pd.DataFrame([(t, node, *(v.tolist() for v in made))], columns=["tree", "node", "feature", "cut", "left", "value", "gains"])

    return _dealt(own, nodes, True).repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(part, _PART)


class DeepForest(Model):
    """The mean over trees whose lower parts are rows of a table."""

    def __init__(self, bounds: list[np.ndarray], top: Top, parts: DataFrame, tasks: int) -> None:
        super().__init__()
        self.bounds, self.top, self.parts, self.tasks = bounds, top, parts, tasks

    @property
    def getNumTrees(self) -> int:  # noqa: N802 (Spark ML's name)
        return len(self.top.nodes)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Gains by feature, each tree's as shares."""
        total = np.zeros((self.getNumTrees, len(self.bounds)))
        for t, own in enumerate(self.top.gains):
            for f, gain in own.items():
                total[t, f] += gain
        for r in self.parts.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).toLocalIterator():
            total[r["tree"], r["f"]] += r["g"]
        own = total.sum(axis=1, keepdims=True)
        shares = np.divide(total, own, out=np.zeros_like(total), where=own > 0).sum(axis=0)
        return DenseVector(shares / (shares.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds = self.bounds

        @F.arrow_udf("binary")
        def bins(v: pa.Array) -> pa.Array:
            return pa.array([r.tobytes() for r in _bins(v, bounds)], pa.binary())

        rows = stored(dataset.withColumn("_bins", bins(vector_to_array("features"))))
        each = stored(rows.select(F.col("_bins").alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()))
        told = self._told(each) if each.count() <= PART_ROWS else self._dealt(each)
        return rows.join(told.withColumnRenamed("x", "_bins"), "_bins").drop("_bins")

    def _told(self, each: DataFrame) -> DataFrame:
        """What the trees say of each different row, all of which a task holds."""
        spark, tops, count = each.sparkSession, self.top.nodes, self.getNumTrees
        given = spark.sparkContext.broadcast(np.frombuffer(b"".join(each.select("x").toArrow().column("x").to_pylist()), np.uint8).reshape(-1, len(self.bounds)))
        block = 50_000

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = given.value
            total = np.zeros(len(x))
            for b in batches:
                for i, (t, node) in enumerate(zip(b.column("tree").to_pylist(), b.column("node").to_pylist(), strict=True)):
                    feature, cut, left, value = (b.column(c)[i].values.to_numpy() for c in ("feature", "cut", "left", "value"))
                    own = np.flatnonzero(walk(x, *tops[t][:3]) == node)
                    total[own] += value[walk(x[own], feature, cut, left)]
            for k in range(0, len(x), block):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "total": pa.array([total[k : k + block].tobytes()], pa.binary())})

        def mean(found: pd.DataFrame) -> pd.DataFrame:
            k = int(found["block"].iloc[0])
            said = sum(np.frombuffer(b) for b in found["total"]) / count
            return pd.DataFrame({"x": [r.tobytes() for r in given.value[k : k + block]], "prediction": said})

        # some trees a batch, as each is as large as its rows
        parts = self.parts.select("tree", "node", "feature", "cut", "left", "value").repartition(max(1, min(self.parts.count(), 4 * spark.sparkContext.defaultParallelism)))
        return parts.mapInArrow(told, "block int, total binary").groupBy("block").applyInPandas(mean, "x binary, prediction double")

    def _dealt(self, each: DataFrame) -> DataFrame:
        dealt = _dealt(each, self.top.nodes, False)

        def told(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"id": [], "p": []}).astype({"id": "int64", "p": "float64"})
            feature, cut, left, value = (np.asarray(tree[c].iloc[0]) for c in ("feature", "cut", "left", "value"))
            x = np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(len(rows), -1)
            return pd.DataFrame({"id": rows["id"], "p": value[walk(x, feature, cut, left)]})

        sides = (side.repartition(self.tasks, "tree", "node").groupBy("tree", "node") for side in (dealt, self.parts))
        said = next(sides).cogroup(next(sides)).applyInPandas(told, "id long, p double")
        return each.join(said.groupBy("id").agg(F.avg("p").alias("prediction")), "id").drop("id")

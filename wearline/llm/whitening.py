"""Whitening of embeddings by shifted Cholesky QR.

Entries are put on a grid (``floor(256 c)``), each distinct vector counts once in the fit.  Then

1. the distinct vectors are written once; one pass gives their number and exact sums;
2. each Gram pass centres the rows, orthogonalises them by triangular solves with the factors found
   so far and adds up their second moments (one matrix per task).  The moments' Cholesky factor is
   the next one: the first time with a shift, which keeps it away from breaking down whatever the
   condition of the rows, then without, until the moments are the identity;
3. the product of the factors is R of the rows' QR decomposition; the singular vectors and values of
   R are the components and, squared over the number of vectors, their variances;
4. a last pass over the distinct vectors measures how far the whitened ones are from unit covariance.

What the driver holds is a matrix of one vector length each way, not rows.  Vectors of different
lengths are fits of their own.

Defined cases: null vectors and those with null, NaN or infinite entries, or entries too large for
the grid's whole numbers, are dropped; repeated rows count once in the fit and each have their
result; a component without variance (``n`` of 1, equal vectors, fewer independent dimensions than
asked for) explains 0 and has a null ``whitened``; an empty vector has no components and so no rows;
null ids stay null; an empty table has no rows; a deviation beyond a long raises; other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.sources.tables import work_dir, write_parquet

SCALE = 256
#: Passes after which the rest of the moments is taken as it is (rows of lower rank never become orthonormal).
PASSES = 5
#: Moments this near to the identity are orthonormal.
TOLERANCE = 1e-12
#: Entries of one matrix in a task.
BLOCK = 1 << 21


@dataclass
class Fit:
    """What vectors of one length need for their result."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def on_grid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, x) of the rows that remain, x being whole numbers."""
    c = df[vector].cast("array<double>")
    rows = df.select(df[key].alias("id"), c.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 54))))
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each vector length of a batch (dim, x) in blocks of bounded size: the length, the rows' numbers and their matrix."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        rows, most = np.flatnonzero(dims == d), max(1, BLOCK // d)
        for low in range(0, len(rows), most):
            own = rows[low : low + most]
            yield d, own, batch.column("x").take(pa.array(own)).flatten().to_numpy().reshape(-1, d)


def _totals(distinct: DataFrame) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Numbers of vectors and exact sums of their entries by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, own, x in _matrices(batch):
                # two halves of 31 bits, so that sums of many rows stay exact
                told = found.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                told[0] += len(own)
                told[1] += (x >> 31).sum(axis=0)
                told[2] += (x & ((1 << 31) - 1)).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d)), pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)], ["dim", "i", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    counts: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in distinct.mapInArrow(run, "dim int, i long, n long, high long, low long").groupBy("dim", "i").agg(F.sum("n").alias("n"), whole("high"), whole("low")).toLocalIterator():
        counts[r["dim"]] = r["n"]
        sums.setdefault(r["dim"], {})[r["i"]] = (int(r["high"]) << 31) + int(r["low"])
    return counts, {d: [own[i] for i in range(d)] for d, own in sums.items()}


def _summed(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """Sums over all rows of ``of(dim, x)``, an array per vector length, one per task and length on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                sums[d] = sums.get(d, 0) + of(d, x)
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["dim", "i", "s"])

    out: dict[int, dict[int, float]] = {}
    for r in rows.mapInArrow(run, "dim int, i long, s double").groupBy("dim", "i").agg(F.sum("s").alias("s")).toLocalIterator():
        out.setdefault(r["dim"], {})[r["i"]] = r["s"]
    return {d: np.array([m[i] for i in range(len(m))]) for d, m in out.items()}


def _solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, one column after the other."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(len(r)):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def _factor(moments: np.ndarray, n: int, first: bool) -> np.ndarray | None:
    """The upper Cholesky factor, shifted in the first pass and wherever it would break down; null moments have none."""
    d, size = len(moments), float(np.linalg.norm(moments, 2))
    if size == 0:
        return None
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    for times in ([shift] if first else [0.0, shift]):
        try:
            return np.linalg.cholesky(moments + times * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    return np.linalg.cholesky(moments + 1e-6 * size * np.eye(d)).T


def _root(moments: np.ndarray) -> np.ndarray:
    """A matrix whose product with its transpose gives the moments, also singular ones."""
    e, v = np.linalg.eigh(moments)
    return np.sqrt(np.maximum(e, 0))[:, None] * v.T


def components(distinct: DataFrame) -> dict[int, Fit]:
    """The fit of each vector length, from its distinct vectors (dim, x)."""
    counts, total = _totals(distinct)
    mean = {d: np.array([s / counts[d] for s in own]) for d, own in total.items()}
    factors: dict[int, list[np.ndarray]] = {d: [] for d in counts}
    last: dict[int, np.ndarray] = {}
    going = set(counts)
    for step in range(PASSES):

        def gram(d: int, x: np.ndarray) -> np.ndarray:
            if d not in going:
                return np.zeros(0)
            q = _solved(x - mean[d], factors[d])
            return q.T @ q

        for d, m in _summed(distinct, gram).items():
            last[d] = m.reshape(d, d)
            if step and np.abs(last[d] - np.eye(d)).max() <= TOLERANCE:
                going.discard(d)
                continue
            if step + 1 == PASSES:
                continue
            factor = _factor(last[d], counts[d], not step)
            if factor is None:
                going.discard(d)
            else:
                factors[d].append(factor)
        going &= {d for d in going if last[d].any()}
        if not going:
            break
    fits = {}
    for d, n in counts.items():
        r = _root(last[d])
        for f in reversed(factors[d]):
            r = r @ f
        _, s, vt = np.linalg.svd(r)
        e = s * s / n
        floor = e.max(initial=0) * d * 1e-15
        e = np.where(e > floor, e, 0.0)
        fits[d] = Fit(n, total[d], vt, e, e / e.sum() if e.sum() > 0 else e)
    return fits


def _whitened(x: np.ndarray, fit: Fit, k: int) -> np.ndarray:
    """Coordinates by the first components with unit variance; 0 for those without variance."""
    live = fit.variances[:k] > 0
    return (x - fit.mean) @ fit.components[:k].T * np.divide(1.0, np.sqrt(fit.variances[:k]), out=np.zeros(len(live)), where=live)


def _deviation(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Exact sums of (n x - S)^2; Python's whole numbers where 64 bits might not do."""
    s = np.array(fit.sums, object)
    far = fit.n * int(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))
    if far * far * len(fit.sums) < 1 << 63:
        return ((fit.n * x - s.astype(np.int64)) ** 2).sum(axis=1)
    return np.array([int(v) for v in ((fit.n * x.astype(object) - s) ** 2).sum(axis=1)], np.int64)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row that remains and its first ``k`` components."""
    spark = df.sparkSession
    rows = on_grid(df, key, vector)
    path = work_dir(spark, "vectors")
    write_parquet(rows.select("dim", "x").distinct(), path)
    distinct = spark.read.parquet(path)
    fits = components(distinct)
    sent = spark.sparkContext.broadcast(fits)

    def spread(d: int, x: np.ndarray) -> np.ndarray:
        w = _whitened(x, sent.value[d], k)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    for d, sums in _summed(distinct, spread).items():
        own, many = fits[d], min(k, d)
        mean = sums[:many] / own.n
        off = sums[many:].reshape(many, many) / own.n - np.outer(mean, mean) - np.eye(many)
        live = own.variances[:many] > 0
        own.error = float(np.abs(off[live][:, live]).max(initial=0)) if live.any() else None
    told = spark.sparkContext.broadcast(fits)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for d, own, x in _matrices(batch):
                fit, many = told.value[d], min(k, d)
                w = _whitened(x, fit, many).ravel()
                each = np.repeat(np.arange(len(own)), many)
                number = np.tile(np.arange(many), len(own))
                dead = fit.variances[number] <= 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(own[each])), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(each), fit.n, np.int64)),
                    pa.array(_deviation(x, fit)[each]), pa.array(w, mask=dead), pa.array(fit.explained[number]),
                    pa.array([fit.error] * len(each), pa.float64()),
                ], names)

    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", key)

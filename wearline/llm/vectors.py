"""Cosine links between vectors of one label by PCA-ordered tiled comparison.

1. One pass sums the second moments of the unit vectors (64 x 64 for 64 dimensions); their
   eigenvectors, strongest first, are an orthonormal basis, so products stay what they are.
2. Vectors are sorted by (label, first leading coordinate) and packed into tiles of at most
   ``tile`` rows of one label.  A tile's summary holds the bounds of its leading coordinates and
   the largest norm of the rest (the suffix).
3. Two tiles of a label are compared only if the largest product that their bounds and suffix
   norms allow reaches the threshold.
4. Within a pair of tiles the products of the leading dimensions are accumulated step by step;
   after each step only pairs whose partial product plus the product of their suffix norms can
   still reach the threshold go on.  What is left is decided by the whole vectors as given, in
   double precision.

A tile pair returns link counts per vector and a spanning forest of its links, not the links, so
a group of equal or near vectors costs rows in proportion to its size.  Components come from the
forests.

Defined cases: null labels, null vectors, null ids, zero vectors and vectors with null, infinite
or NaN components link with nothing and are kept as their own component (null for a null id);
vectors of other length than most of their label are compared with those of their length only;
rows with equal ids are one node of the graph; ids are whole numbers; other columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.components import components
from wearline.llm.session import cut


def _valid(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows that can link: id, group (label and length) and the vector in double precision."""
    v = df[vector].cast("array<double>")
    return (
        df.select(df[key].alias("id"), df[label].alias("label"), v.alias("v"))
        .where("id is not null and label is not null and size(v) > 0")
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
        .select("id", F.concat_ws(":", F.size("v"), F.col("label").cast("string")).alias("grp"), F.size("v").alias("dim"), "v")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the orthonormal axes, strongest first; one sum per entry of the moments comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                x = _unit(_matrix(batch.column(1).filter(pa.array(dims == d)), int(d)))
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["dim", "i", "x"])

    moments: dict[int, np.ndarray] = {}
    summed = rows.select("dim", "v").mapInArrow(run, "dim int, i long, x double").groupBy("dim", "i").agg(F.sum("x").alias("x"))
    for r in summed.toLocalIterator():
        moments.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["i"]] = r["x"]
    axes = {}
    for d, m in moments.items():
        _, vectors = np.linalg.eigh(m.reshape(d, d))
        axes[d] = np.ascontiguousarray(vectors[:, ::-1])
    return axes


TILE = "grp string, tile long, n int, dim int, low array<double>, high array<double>, suffix double, ids binary, unit binary, pca binary"


def _tiles(rows: DataFrame, axes: dict[int, np.ndarray], tile: int, lead: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            first = np.zeros(len(batch))
            for d in np.unique(dims):
                own = dims == d
                first[own] = _unit(_matrix(batch.column(3).filter(pa.array(own)), int(d))) @ sent.value[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], ["id", "grp", "dim", "v", "first"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def emit(part: pa.Table) -> pa.RecordBatch:
            d = part.column("dim")[0].as_py()
            raw = _matrix(part.column("v").combine_chunks(), d)
            unit = _unit(raw)
            pca = unit @ sent.value[d]
            k = min(lead, d)
            rest = np.sqrt((pca[:, k:] ** 2).sum(axis=1))
            return pa.RecordBatch.from_pylist([{
                "grp": part.column("grp")[0].as_py(), "tile": number, "n": len(raw), "dim": d,
                "low": pca[:, :k].min(axis=0).tolist(), "high": pca[:, :k].max(axis=0).tolist(), "suffix": float(rest.max()),
                "ids": part.column("id").to_numpy().astype(np.int64).tobytes(), "unit": unit.tobytes(), "pca": pca.astype(np.float32).tobytes(),
            }], schema=schema)

        schema = pa.schema([("grp", pa.string()), ("tile", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("suffix", pa.float64()), ("ids", pa.binary()), ("unit", pa.binary()), ("pca", pa.binary())])
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while len(table):
                group = table.column("grp").to_numpy(zero_copy_only=False)
                end = int(np.argmax(group != group[0])) or len(group)
                if end == len(group) and end < tile:
                    break
                cut_at = min(end, tile)
                yield emit(table.slice(0, cut_at).combine_chunks())
                number += 1
                table = table.slice(cut_at)
            held = table.to_batches()
        if held and sum(map(len, held)):
            yield emit(pa.Table.from_batches(held).combine_chunks())

    ordered = rows.mapInArrow(project, "id long, grp string, dim int, v array<double>, first double")
    ordered = ordered.repartitionByRange("grp", "first", "id").sortWithinPartitions("grp", "first", "id")
    return ordered.mapInArrow(pack, TILE)


def _compare(a: dict, b: dict | None, threshold: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs; without b within a."""
    d = a["dim"]
    pa_, ua = np.frombuffer(a["pca"], np.float32).reshape(-1, d), np.frombuffer(a["unit"]).reshape(-1, d)
    pb, ub = (pa_, ua) if b is None else (np.frombuffer(b["pca"], np.float32).reshape(-1, d), np.frombuffer(b["unit"]).reshape(-1, d))
    k = min(steps[0], d)
    partial = pa_[:, :k] @ pb[:, :k].T
    ra, rb = np.sqrt(np.maximum(0, (pa_[:, k:] ** 2).sum(1))), np.sqrt(np.maximum(0, (pb[:, k:] ** 2).sum(1)))
    # float32 sums of at most d terms of products of unit vectors: their error is far below 1e-4
    i, j = np.nonzero(partial + ra[:, None] * rb[None, :] >= threshold - 1e-4)
    if b is None:
        i, j = i[i < j], j[i < j]
    sums, done = partial[i, j], k
    for step in steps[1:]:
        if done >= d or not len(i):
            break
        k = min(step, d)
        sums = sums + np.einsum("ij,ij->i", pa_[i, done:k], pb[j, done:k])
        ra, rb = np.sqrt((pa_[:, k:] ** 2).sum(1)), np.sqrt((pb[:, k:] ** 2).sum(1))
        able = sums + ra[i] * rb[j] >= threshold - 1e-4
        i, j, sums, done = i[able], j[able], sums[able], k
    exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", ua[i[s : s + 65536]], ub[j[s : s + 65536]]) for s in range(0, len(i), 65536))])
    hit = exact >= threshold
    return i[hit], j[hit]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all rows which the given links join (at most n - 1 of them)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return [(int(x), int(r)) for x, r in enumerate(label.tolist()) if x != r]


def links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, threshold: float = 0.98, tile: int = 1024, lead: int = 8) -> DataFrame:
    """Rows (id, n, null) with link counts and rows (id, 0, other) that span the links."""
    rows = _valid(df, key, vector, label)
    axes = principal_axes(rows)
    tiles = cut(_tiles(rows, axes, tile, lead))
    bound = tiles.select("grp", "tile", "low", "high", "suffix")
    left = bound.select("grp", F.col("tile").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.col("suffix").alias("asx"))
    right = bound.select("grp", F.col("tile").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.col("suffix").alias("bsx"))
    most = F.expr(
        "aggregate(sequence(0, size(al) - 1), asx * bsx, (acc, i) -> acc + greatest(al[i] * bl[i], al[i] * bh[i], ah[i] * bl[i], ah[i] * bh[i]))"
    )
    pairs = left.join(right, "grp").where((F.col("a") <= F.col("b")) & ((F.col("a") == F.col("b")) | (most >= threshold - 1e-6))).select("a", "b")
    blob = tiles.select("tile", "dim", "ids", "unit", "pca")
    one = blob.select(F.col("tile").alias("a"), F.struct("dim", "ids", "unit", "pca").alias("x"))
    two = blob.select(F.col("tile").alias("b"), F.struct("dim", "ids", "unit", "pca").alias("y"))
    joined = pairs.repartition("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")
    steps = (lead, 2 * lead, 4 * lead, 10**9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x = batch.column(2)[r].as_py()
                same = batch.column(0)[r].as_py() == batch.column(1)[r].as_py()
                y = None if same else batch.column(3)[r].as_py()
                i, j = _compare(x, y, threshold, steps)
                if not len(i):
                    continue
                ids = np.frombuffer(x["ids"], np.int64)
                other = ids if same else np.frombuffer(y["ids"], np.int64)
                n = len(ids)
                every = ids if same else np.concatenate([ids, other])
                jj = j if same else j + n
                count = np.bincount(i, minlength=len(every)) + np.bincount(jj, minlength=len(every))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(count[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], ["id", "n", "other"])
                tree = np.array(_forest(len(every), i, jj), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(every[tree[:, 0]]), pa.array(np.zeros(len(tree), np.int64)), pa.array(every[tree[:, 1]])], ["id", "n", "other"])

    return joined.mapInArrow(run, "id long, n long, other long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, threshold: float = 0.98, tile: int = 1024, lead: int = 8) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``."""
    found = cut(links(df, key, vector, label, threshold=threshold, tile=tile, lead=lead))
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n_links"))
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    facts = counts.join(groups, "id", "left")
    slim = df.select(df[key].alias("id"))
    return slim.join(facts, "id", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )

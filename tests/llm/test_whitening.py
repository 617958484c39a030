"""Whitened vectors against the eigenvectors of the plain covariance."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import whitening
from wearline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<double>"


def plain(vectors, k=4):
    """n, deviations, whitened coordinates and explained shares by numpy's eigenvectors."""
    x = np.array([[int(np.floor(256 * np.float64(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def compare(got, ids, vectors):
    n, deviation, whitened, explained = plain(vectors)
    got = got.sort_values(["vec_id", "component"])
    order, k = np.argsort(ids, kind="stable"), whitened.shape[1]
    assert got.vec_id.tolist() == np.repeat(np.array(ids)[order], k).tolist() and set(got.n) == {n}
    assert got.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == deviation[order].tolist()
    mine = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((mine * whitened[order]).sum(axis=0))  # either sign, the same for all rows
    assert np.abs(mine * sign - whitened[order]).max() < 1e-6
    assert got.explained.to_numpy()[:k] == pytest.approx(explained, rel=1e-9)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] <= 1e-8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_is_the_plain_whitening(spark):
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    compare(QUERIES["op13_embedding_whitening"](spark, DATA).toPandas(), source.vec_id.to_numpy(), source.embedding)


def test_copies_count_once_and_scales_may_differ(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6)) * [3e3, 100, 10, 1, 1, 0.3] + 7
    vectors = np.concatenate([vectors, np.repeat(vectors[:3], 100, axis=0)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], KIND).repartition(5)
    compare(whitening.whiten(df).toPandas(), np.arange(len(vectors)), vectors)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0]), (None, [0.0, 0.1, 0.0]), (6, [1.0, 0.5, 2.0])]
    rows += [(2, None), (3, [None, 1.0, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (7, []), (9, [1e300, 0.0, 0.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("id", "x", "dim", "n", "component")})
    got = whitening.whiten(df).toPandas()
    assert sorted(got.vec_id.fillna(-1).tolist()) == [-1] * 3 + [1] * 6 + [6] * 3 + [8]
    three = got[got.vec_id.isin([1, 6]) | got.vec_id.isna()]
    assert set(three.n) == {3} and three[three.component == 3].whitened.isna().all() and (three[three.component == 3].explained == 0).all()
    assert three[three.component < 3].whitened.notna().all() and three.identity_error.max() < 1e-8
    (lone,) = got[got.vec_id == 8].to_dict("records")
    assert lone["n"] == 1 and lone["deviation"] == 0 and np.isnan(lone["whitened"])
    assert whitening.whiten(df.where("vec_id = 2")).count() == 0


def test_wide_deviations_are_exact(spark):
    df = spark.createDataFrame([(i, [float(i * 2**20), 1.0]) for i in range(3)], KIND)
    got = whitening.whiten(df, k=1).toPandas()
    x = [i * 2**28 for i in range(3)]
    assert sorted(got.deviation) == sorted((3 * v - sum(x)) ** 2 for v in x)
    with pytest.raises(Exception, match="(?i)int too (large|big)|overflow"):
        whitening.whiten(df.withColumn("embedding", F.transform("embedding", lambda c: c * 2**12)), k=1).collect()

"""Models by their properties: ridge's closed form, learning beats persistence, saving and scoring, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.plans import estimators, models
from wearline.plans.estimators import Boosted, Forest, Linear, Ridge
from wearline.sources import tables
from wearline.streaming.ingest import append_by_asset, stream_events


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        ura, iri, h = (float(x) for x in rng.uniform(0, 20, 3))
        rows.append((str(i), None if i % 17 == 0 else ura, iri, h, "abc"[i % 3], ura + 2 * h + (i % 3) * 5 + float(rng.normal())))
    return spark.createDataFrame(rows, "Segment_ID string, URA double, IRI double, target_horizon_years double, Toim_lk string, target_next_URA double")


def test_model_beats_persistence_and_round_trips(table, tmp_path, spark):
    features = ["URA", "IRI", "target_horizon_years", "Toim_lk"]
    fitted = models.fit(table, features, "target_next_URA", Linear())
    learned = models.evaluated(fitted, table).first()
    assert learned["r2"] > 0.8
    unseen = table.withColumn("Toim_lk", F.lit("new"))
    assert fitted.predict(unseen).where("prediction is null").count() == 0
    tables.save_model(fitted.model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    x = models.prepared(table, fitted.numeric, fitted.categories, fitted.fill)
    assert again.transform(x).agg(F.sum("prediction")).first()[0] == pytest.approx(fitted.model.transform(x).agg(F.sum("prediction")).first()[0])
    assert models.weights(fitted, table).count() == len(models.feature_names(fitted, table))


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "URA double, IRI double, y double")
    df = df.unionByName(spark.createDataFrame([(1.0, 2.0, None)] * 20, df.schema))  # rows without a label count for nothing
    for alpha in (1.0, 5.0):
        for kind, label in (("direct", y), ("delta", y - x[:, 0])):
            fitted = models.fit(df, ["URA", "IRI"], "y", Ridge(alpha), target_type=kind, scale=False)
            xc, yc = x - x.mean(0), label - label.mean()
            want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
            assert fitted.model.stages[-1].coefficients.toArray() == pytest.approx(want, abs=1e-6)


def test_scaling_divides_by_the_population_deviation(spark):
    x = np.random.default_rng(4).normal(3, 5, (20, 1))
    df = spark.createDataFrame([(float(a), float(a) * 2) for (a,) in x], "URA double, y double")
    fitted = models.fit(df, ["URA"], "y", Ridge(7.0))
    z = (x - x.mean()) / x.std()
    want = np.linalg.solve(z.T @ z + 7.0, z.T @ (2 * x - 2 * x.mean()))
    assert fitted.model.stages[-1].coefficients.toArray() == pytest.approx(want.ravel(), abs=1e-8)


def test_stated_grids():
    assert (len(models.BOOSTED_GRID), len(models.FOREST_GRID), len(set(models.FOCUSED_GRID))) == (6, 3, 20)
    assert all(not set(v) & set(models.FORBIDDEN) for v in models.FEATURE_MIXTURES.values())
    stated = [*(Boosted(*c) for c in (*models.BOOSTED_GRID, *models.FOCUSED_GRID)), *(Forest(*c) for c in models.FOREST_GRID), Linear(), Ridge(0.5)]
    texts = [estimators.to_json(e) for e in stated]
    assert len(set(texts)) == len(stated) and [estimators.from_json(t) for t in texts] == stated


def test_leaks_are_refused(table):
    with pytest.raises(ValueError):
        models.fit(table, ["target_next_URA"], "target_next_URA", Linear())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "model string, rmse double")
    tables.write_csv(df, str(tmp_path / "r.csv"))
    found = tables.read_results(spark, {"have": str(tmp_path / "r.csv"), "none": str(tmp_path / "none.csv")}, "model string, rmse double")
    assert [tuple(r) for r in found.collect()] == [("a", 1.0, "have")]
    tables.write_manifest(spark, {"seed": 42}, str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")).first()["seed"] == 42
    events = spark.createDataFrame([("S", "PTM", 1, "2006-01-01"), ("S", "PTM", 1, "2006-01-01")], "Segment_ID string, event_type string, slot_idx int, event_date string").withColumn("event_date", F.to_timestamp("event_date"))
    tables.write_by_asset(events, str(tmp_path / "b"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    events.write.parquet(str(tmp_path / "in"))
    query = append_by_asset(stream_events(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "cp"), 4)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def step_table(spark):
    """Rows whose label a few steps tell, with features assembled."""
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(np.sin(a / 9) * 4 + (b > 5) * 3 + rng.normal() / 5), i % 10 == 0) for i, (a, b) in enumerate(rng.uniform(0, 60, (600, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, label double, stop boolean")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def grown(x, rounds, rate=0.3):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=rounds, stepSize=rate / 2, maxDepth=4, minInstancesPerNode=5, seed=1).fit(x)


def test_refit_without_limits_is_the_grown_model(spark):
    x = step_table(spark)
    trees = grown(x, 30)  # more than one block
    again = estimators.refitted(trees, x, 0.3, 16, 0.0)
    mine = [r["prediction"] for r in again.transform(x).orderBy("a").collect()]
    assert mine == pytest.approx([r["prediction"] for r in trees.transform(x).orderBy("a").collect()], abs=1e-8) and again.getNumTrees == 30


def test_leaf_values_have_a_closed_form(spark):
    x = step_table(spark)
    trees = grown(x, 1)
    rows = estimators.with_leaves(trees, x).select("a", "label", "_leaf").orderBy("a").collect()
    y, leaf = np.array([r["label"] for r in rows]), np.array([r["_leaf"][0] for r in rows])
    for l2 in (0.0, 10.0, 1e9):
        model = estimators.refitted(trees, x, 0.3, 16, l2)
        indicators = np.eye(leaf.max() + 1)[leaf]
        ridge = np.linalg.solve(indicators.T @ indicators + l2 * np.eye(indicators.shape[1]), indicators.T @ (y - y.mean()))
        assert model.values[0] == pytest.approx(ridge.tolist()) and model.base == pytest.approx(y.mean())
    few = estimators.refitted(trees, x, 0.3, 3, 0.0)
    assert len(set(few.values[0])) == 3
    error = [np.mean((y - [r["prediction"] for r in estimators.refitted(trees, x, 0.3, n, 0.0).transform(x).orderBy("a").collect()]) ** 2) for n in (2, 5, 16)]
    assert error[0] > error[1] > error[2]


def test_best_splits_first():
    node = estimators.Node
    nodes = {0: node(9, 1, 4), 1: node(1, 2, 3), 2: node(-1, -1, -1), 3: node(-1, -1, -1), 4: node(5, 5, 6), 5: node(-1, -1, -1), 6: node(-1, -1, -1)}
    assert estimators.kept_leaves(nodes, 1) == [0, 0, 0, 0]
    assert estimators.kept_leaves(nodes, 3) == [1, 1, 5, 6]
    assert estimators.kept_leaves(nodes, 99) == [2, 3, 5, 6]


def stepped(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i % 20), float(i // 20 % 9), i * 7919 % 101 / 20 + (3.0 if i % 20 > 11 else 0.0) * (i // 20 % 9) - (4.0 if i // 20 % 9 == 5 else 0.0), i * 31 % 11 == 0) for i in range(3000)]
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, y0 double, stop boolean"))


def test_fits_grown_together_are_those_grown_alone(spark):
    from wearline.plans import boost

    x = stepped(spark)
    tried = [Boosted(0.3, 6, 7, 20), Boosted(0.3, 3, 16, 20, 50.0), Boosted(0.9, 20, 4, 10)]
    fits = [boost.Fit(0, np.array([0, 1]), t) for t in tried] + [boost.Fit(0, np.array([1]), tried[0])]
    bounds = boost.boosted(x, 1, fits)
    got = boost.predicted(x.select("features", "a", "b", "stop"), bounds, fits, ["a", "b", "stop"]).orderBy("a", "b", "stop").collect()
    for i, t in enumerate(tried):
        alone = t.train(x.withColumnRenamed("y0", "label"))
        assert alone.getNumTrees == len(fits[i].trees) > 1
        wanted = [r["prediction"] for r in alone.transform(x).orderBy("a", "b", "stop").collect()]
        assert [r["_p"][i] for r in got] == pytest.approx(wanted, abs=1e-8)
    assert len({r["_p"][3] for r in got}) <= 9  # one feature of nine values


def test_levels_are_written_after_a_block(spark, monkeypatch):
    from wearline.plans import boost

    found = []
    for block in (25, 2):
        monkeypatch.setattr(boost, "BLOCK", block)
        fits = [boost.Fit(0, np.array([0, 1]), Boosted(0.3, 5, 4, 5))]
        boost.boosted(stepped(spark), 1, fits)
        found.append([t.refit.tolist() for t in fits[0].trees])
    assert len(found[0]) == len(found[1]) > 3 and all(a == pytest.approx(b) for a, b in zip(*found, strict=True))


def test_boosted_fits_of_a_grid_share_their_passes(table):
    """More fits of a grid are no more jobs."""
    sc, count = table.sparkSession.sparkContext, []
    train = table.withColumn("target_horizon_days", F.lit(1.0))
    for n in (1, 6):
        sc.setJobGroup(f"boosted-{n}", "grid")
        tried = {f"b{i}": Boosted(0.3, 2, 7, 10, float(i)) for i in range(n)}
        models.grid(train, table, {"all": ["URA", "IRI", "target_horizon_years", "Toim_lk"]}, "target_next_URA", tried)
        count.append(len(sc.statusTracker().getJobIdsForGroup(f"boosted-{n}")))
    sc.setJobGroup("other", "other")
    assert 0 < count[0] <= count[1] < 1.3 * count[0]


def test_grid_tells_candidates_apart(table):
    train = table.withColumn("target_horizon_days", F.lit(1.0))
    features = {"all": ["URA", "IRI", "target_horizon_years", "Toim_lk"]}
    tried = {"a": Boosted(0.3, 5, 7, 10), "b": Boosted(0.3, 5, 7, 10, 50.0), "c": Boosted(0.3, 5, 3, 10), "again": Boosted(0.3, 5, 7, 10), "line": Linear()}
    found = models.grid(train, table, features, "target_next_URA", tried, ("direct", "delta")).collect()
    assert len(found) == 8 and {r["model"] for r in found} == {"a", "b", "c", "line"}
    assert len({(r["target_type"], r["rmse"]) for r in found}) >= 7 and all(r["fit_seconds"] > 0 and r["r2"] > 0.3 for r in found)
    assert models.distinct_candidates(models.grid(train, table, features, "target_next_URA", tried).unionByName(models.grid(train, table, features, "target_next_URA", {"named_otherwise": Linear()}))).count() == 4


def test_permutation_importance_equals_brute_force(table):
    features = ["URA", "IRI", "target_horizon_years", "Toim_lk"]
    fitted = models.fit(table, features, "target_next_URA", Linear())
    got = {r["feature"]: r["rmse_increase"] for r in models.permutation_importance(fitted, table, features, ["Segment_ID"], 2).collect()}
    import hashlib

    rows = [r.asDict() for r in table.collect()]

    def rmse(changed):
        out = fitted.predict(table.sparkSession.createDataFrame(changed, table.schema)).collect()
        return np.sqrt(np.mean([(r["target_next_URA"] - r["prediction"]) ** 2 for r in out]))

    for f in ("IRI", "Toim_lk"):
        increases = []
        for k in range(2):
            order = sorted(rows, key=lambda r: hashlib.md5(f"{1000 + k}|{r['Segment_ID']}".encode()).hexdigest())
            increases.append(rmse([{**r, f: order[i - 1][f]} for i, r in enumerate(order)]) - rmse(rows))
        assert got[f] == pytest.approx(np.mean(increases), abs=1e-9) and (f == "IRI" or got[f] > 0.05)


def test_response_equals_brute_force(table, spark):
    features = ["URA", "IRI", "target_horizon_years", "Toim_lk"]
    train = table.where("URA is not null")
    fitted = models.fit(train, features, "target_next_URA", Linear(), target_type="delta")
    values = spark.createDataFrame([(1.0,), (15.0,)], "v double")
    got = {r["grid_value"]: r for r in models.response(fitted, train, "IRI", values, 10_000, ["Segment_ID"]).collect()}
    for v in (1.0, 15.0):
        rows = fitted.predict(train.withColumn("IRI", F.lit(v))).collect()
        change = [r["prediction"] - r["URA"] for r in rows]
        r = got[v]
        assert r["rows"] == len(rows) and r["mean_level"] == pytest.approx(np.mean([x["prediction"] for x in rows])) and r["mean_raw"] == pytest.approx(np.mean(change))
        assert (r["mean_change"], r["p10_change"], r["p90_change"]) == pytest.approx((np.mean(change), np.quantile(change, 0.1), np.quantile(change, 0.9)))
    assert models.response(fitted, train, "IRI", values, 50, ["Segment_ID"]).first()["rows"] == 50


def test_parts_are_one_forest(spark, monkeypatch):
    x = step_table(spark)
    monkeypatch.setattr(estimators, "PART", 4)
    model = Forest(10, "all", 5).train(x)
    assert [p.getNumTrees for p in model.parts] == [4, 4, 2] and model.getNumTrees == 10
    assert sum(model.featureImportances) == pytest.approx(1)
    each = [[r["p"] for r in t.transform(x).orderBy("a").select(F.col("prediction").alias("p")).collect()] for p in model.parts for t in p.trees]
    assert [r["prediction"] for r in model.transform(x).orderBy("a").collect()] == pytest.approx(np.mean(each, axis=0))


def test_linear_grid_reads_the_rows_once_and_equals_single_fits(table, monkeypatch):
    mixtures = {"all": ["URA", "IRI", "target_horizon_years", "Toim_lk"], "few": ["IRI", "target_horizon_years"]}
    tried = {"line": Linear(), "ridge": Ridge(3.0)}
    single = {(m, k, t): models.evaluated(models.fit(table, mixtures[m], "target_next_URA", e, target_type=t), table).first() for m in mixtures for k, e in tried.items() for t in ("direct", "delta")}

    def refused(*_, **__):
        raise AssertionError("a pass over the rows for one fit")

    monkeypatch.setattr(models, "fit_encoded", refused)
    found = models.grid(table, table, mixtures, "target_next_URA", tried, ("direct", "delta")).collect()
    assert len(found) == len(single) == 8
    for r in found:
        want = single[r["feature_mixture"], r["model"], r["target_type"]]
        assert r["evaluation_rows"] == want["rows"] and [r["mae"], r["rmse"], r["r2"]] == pytest.approx([want["mae"], want["rmse"], want["r2"]], abs=1e-5)


def test_forest_on_many_rows_is_dealt_by_node(spark, monkeypatch):
    x = step_table(spark)
    want = models.metrics(Forest(20, "all", 5).train(x).transform(x), "label", "prediction").first()
    monkeypatch.setattr(estimators.forest, "FEW_ROWS", 100)
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 100)
    monkeypatch.setattr(estimators.forest, "PASS_NODES", 7)
    model = Forest(20, "all", 5).train(x)
    got = models.metrics(model.transform(x), "label", "prediction").first()
    assert got["rows"] == 600 and model.getNumTrees == 20 and got["rmse"] == pytest.approx(want["rmse"], rel=0.15)
    parts = model.parts.collect()
    assert len(parts) > 60 and all(len(r["value"]) == len(r["feature"]) for r in parts)  # more than three below each top
    assert sum(model.featureImportances) == pytest.approx(1) and model.featureImportances[0] > model.featureImportances[1]


def test_weights_of_a_dealt_forest_name_every_feature(table, monkeypatch):
    monkeypatch.setattr(estimators.forest, "FEW_ROWS", 100)
    fitted = models.fit(table, ["URA", "IRI", "target_horizon_years", "Toim_lk"], "target_next_URA", Forest(3, "all", 5))
    found = models.weights(fitted, table).collect()
    assert len({r["feature"] for r in found}) == len(found) == 6 and sum(r["weight"] for r in found) == pytest.approx(1)


def test_one_tree_is_the_best_split_of_its_rows():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, (300, 2)).astype(np.uint8), rng.normal(size=300)
    w, sizes = rng.integers(1, 4, 300).astype(float), np.array([6, 6])
    feature, cut, left, value, gains = estimators.forest.grown(x, y, w, sizes, 1, 10, 2, rng)

    def error(f, c):
        sides = [x[:, f] <= c, x[:, f] > c]
        return sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in sides)

    assert (feature[0], cut[0]) == min(((f, c) for f in range(2) for c in range(5)), key=lambda k: error(*k))
    assert gains.sum() == pytest.approx((w * (y - np.average(y, weights=w)) ** 2).sum() - error(feature[0], cut[0]))
    leaf = estimators.forest.walk(x, feature, cut, left)
    assert set(leaf) == {1, 2} and value[1] == pytest.approx(np.average(y[leaf == 1], weights=w[leaf == 1]))


def test_equal_rows_are_one_row_with_their_number(spark, monkeypatch):
    x = step_table(spark)
    want = models.metrics(Forest(20, "all", 5).train(x).transform(x), "label", "prediction").first()
    monkeypatch.setattr(estimators.forest, "FEW_ROWS", 100)
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 700)
    many = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    model = Forest(20, "all", 25).train(many)  # five times the rows in a leaf
    parts = model.parts.collect()
    assert sorted((r["tree"], r["node"]) for r in parts) == [(t, 0) for t in range(20)]  # 3,000 rows are 600, which a task holds: no tree is cut
    got = models.metrics(model.transform(many), "label", "prediction").first()
    assert got["rows"] == 3000 and got["rmse"] == pytest.approx(want["rmse"], rel=0.15)
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 10_000)
    whole = {r["a"]: r["prediction"] for r in model.transform(x).collect()}
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 10)
    assert {r["a"]: r["prediction"] for r in model.transform(x).collect()} == pytest.approx(whole)  # scored by parts of trees


def test_copies_in_a_bag_are_poisson_draws():
    ids = np.arange(200_000)
    for mean in (1, 2, 50, 3000):
        drawn = estimators.forest.copies(ids, 3, np.full(len(ids), mean))
        assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(mean, rel=0.02)
    mixed = estimators.forest.copies(ids, 3, 1 + 49 * (ids % 2))
    assert (mixed[::2] == estimators.forest.copies(ids, 3, np.ones(len(ids), int))[::2]).all() and (mixed[1::2] == estimators.forest.copies(ids, 3, np.full(len(ids), 50))[1::2]).all()


def test_forests_of_a_grid_are_the_single_ones(table, monkeypatch):
    monkeypatch.setattr(estimators.forest, "FEW_ROWS", 100)
    train = table.withColumn("target_horizon_days", F.lit(1.0)).where("URA is not null")
    features = {"all": ["URA", "IRI", "target_horizon_years", "Toim_lk"], "few": ["URA", "IRI"]}
    tried = {"a": Forest(12, "0.5", 5), "b": Forest(5, "all", 20)}
    want = {(k, t): models.evaluated(models.fit(train, features["all"], "target_next_URA", e, target_type=t), train).first() for k, e in tried.items() for t in ("direct", "delta")}

    def refused(*_, **__):
        raise AssertionError("a fit of its own")

    with monkeypatch.context() as m:
        m.setattr(models, "fit_encoded", refused)
        found = models.grid(train, train, features, "target_next_URA", tried, ("direct", "delta")).collect()
    assert len(found) == 8
    for r in found:
        if r["feature_mixture"] == "all":
            w = want[r["model"], r["target_type"]]
            assert r["evaluation_rows"] == w["rows"] and [r["mae"], r["rmse"], r["r2"]] == pytest.approx([w["mae"], w["rmse"], w["r2"]], rel=0.1)
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 50)  # too many for a task: fitted one by one, with the same result but for the draws
    again = {(r["model"], r["target_type"], r["feature_mixture"]): r["rmse"] for r in models.grid(train, train, features, "target_next_URA", {"a": tried["a"]}).collect()}
    assert again["a", "direct", "all"] == pytest.approx(next(r["rmse"] for r in found if (r["model"], r["target_type"], r["feature_mixture"]) == ("a", "direct", "all")), rel=0.2)


def test_boosted_fits_count_equal_rows(spark):
    from wearline.plans import boost

    x, found = stepped(spark), []
    for times, spec in ((1, Boosted(0.3, 6, 7, 20, 1.0)), (3, Boosted(0.3, 6, 7, 60, 3.0))):
        fits = [boost.Fit(0, np.array([0, 1]), spec)]
        boost.boosted(x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))), 1, fits)
        found.append([t.refit.tolist() for t in fits[0].trees])
    assert len(found[0]) == len(found[1]) > 1 and all(a == pytest.approx(b) for a, b in zip(*found, strict=True))


def test_permutation_importance_of_boosted_trees_is_scored_in_arrays(table, monkeypatch):
    features = ["URA", "IRI", "target_horizon_years", "Toim_lk"]
    train = table.withColumn("unseen", F.col("Toim_lk")).where("Toim_lk != 'c'")
    fitted = models.fit(train, features, "target_next_URA", Boosted(0.3, 8, 9, 10), target_type="delta")
    rows = table.where("URA is not null")  # with a category that no tree knows
    scored = rows.transform(fitted.predict).orderBy("Segment_ID").collect()
    got = {r["feature"]: r for r in models.permutation_importance(fitted, rows, features, ["Segment_ID"], 2).collect()}
    assert set(got) == set(features) and got["URA"]["rmse_increase"] > 0.5
    import hashlib

    plain = [r.asDict() for r in rows.collect()]
    rmse = lambda out: np.sqrt(np.mean([(r["target_next_URA"] - r["prediction"]) ** 2 for r in out]))
    for f in ("URA", "Toim_lk"):
        found = []
        for k in range(2):
            order = sorted(plain, key=lambda r: hashlib.md5(f"{1000 + k}|{r['Segment_ID']}".encode()).hexdigest())
            found.append(rmse(fitted.predict(rows.sparkSession.createDataFrame([{**r, f: order[i - 1][f]} for i, r in enumerate(order)], rows.schema)).collect()) - rmse(scored))
        assert got[f]["rmse_increase"] == pytest.approx(np.mean(found), abs=1e-9) and got[f]["std"] == pytest.approx(np.std(found), abs=1e-9)

    def refused(*_, **__):
        raise AssertionError("rows of every feature and repeat are encoded anew")

    base = models.evaluated(fitted, rows)
    monkeypatch.setattr(models, "evaluated", lambda *_: base)
    monkeypatch.setattr(models.Fitted, "predict", refused)
    assert {r["feature"] for r in models.permutation_importance(fitted, rows, features, ["Segment_ID"], 1).collect()} == set(features)


def test_importances_count_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(estimators.forest, "FEW_ROWS", 100)
    monkeypatch.setattr(estimators.forest, "PART_ROWS", 700)
    x = step_table(spark)
    one, many = (Forest(10, "all", 5 * k).train(x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))) for k in (1, 5))
    assert one.parts.count() == many.parts.count() == 10  # the copies add no parts
    assert many.featureImportances.toArray() == pytest.approx(one.featureImportances.toArray(), abs=0.1) and sum(many.featureImportances) == pytest.approx(1)

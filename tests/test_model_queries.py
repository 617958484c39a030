"""Queries that fit models: their rows by properties, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def test_linear_grid(spark):
    found = rows(spark, "ml_06_12_15_validation_grid")
    assert len(found) == 2 * 5 * 2 * 2 and len({(r["model"], r["target"], r["target_type"], r["feature_mixture"]) for r in found}) == len(found)
    assert all(r["rmse"] > 0 and r["evaluation_rows"] > 0 and r["persistence_rmse"] > 0 for r in found)
    best = min(r["rmse"] for r in found if r["target"] == "target_next_URA")
    assert best < next(r["persistence_rmse"] for r in found if r["target"] == "target_next_URA")
    # A line through level and difference is the same fit, as the current level is a feature.
    pair = {r["target_type"]: r["rmse"] for r in found if r["model"] == "linear" and r["target"] == "target_next_URA" and r["feature_mixture"] == "current"}
    assert pair["direct"] == pytest.approx(pair["delta"], abs=1e-4)


def test_band_ablation(spark):
    found = rows(spark, "ml_24_flt_08_band_ablation")
    assert len(found) == 3 * 2 * 5 and {r["model"] for r in found} == {"linear", "ridge", "boosted_trees"}
    assert all(r[f"h{h}y_{c}"] > 0 for r in found for h in (1, 2, 3, 4) for c in ("rmse", "persistence_rmse", "rows"))


def test_tree_grid(spark):
    found = rows(spark, "ml_12_tree_grid")
    assert len(found) == 2 * 5 * 2 and len({(r["model"], r["target"], r["feature_mixture"]) for r in found}) == len(found)
    assert all(r["rmse"] < r["persistence_rmse"] and r["fit_seconds"] > 0 for r in found)


def test_final_model(spark):
    found = {r["target"]: r for r in rows(spark, "ml_14_16_17_src_04_snk_03_04_final_model")}
    assert set(found) == {"target_next_URA", "target_next_IRI"}
    # four linear and two tree candidates for two mixtures and two kinds of target; the repeated table adds none
    assert all(r["seed"] == 42 and r["candidates"] == 6 * 2 * 2 and r["production_rows"] > r["test_rows"] > 0 and r["rmse"] < r["persistence_rmse"] for r in found.values())


def test_boosted_forest_and_weights(spark):
    (r,) = rows(spark, "ml_11_boosted_trees")
    assert 1 <= r["trees"] < 400 and r["rmse"] < r["persistence_rmse"]
    found = rows(spark, "ml_10_random_forest_breakdown")
    assert found and all(r["rmse"] is None or r["rmse"] >= r["mae"] for r in found)
    weight = rows(spark, "ml_18_19_weights")
    assert {r["model"] for r in weight} == {"linear", "random_forest"}
    assert sum(r["weight"] for r in weight if r["model"] == "random_forest") == pytest.approx(1, abs=1e-4)


def test_permutation_response_encoding_and_scores(spark):
    increase = {r["feature"]: r["rmse_increase"] for r in rows(spark, "ml_20_permutation_importance")}
    assert len(increase) == 17 and max(increase, key=increase.get) == "URA"
    found = rows(spark, "ml_21_joi_10_agg_40_response")
    assert found and all(r["p10_change"] <= r["p90_change"] and r["rows"] == found[0]["rows"] > 100 for r in found)
    # a linear model answers in proportion to the change of the feature
    found.sort(key=lambda r: r["grid_value"])
    slopes = [(b["mean_change"] - a["mean_change"]) / (b["grid_value"] - a["grid_value"]) for a, b in zip(found, found[1:])]
    assert slopes == pytest.approx([slopes[0]] * len(slopes), abs=1e-4)
    encoded = rows(spark, "ml_22_encoding")
    assert encoded and all(math.isfinite(r["encoded"]) for r in encoded)
    scored = rows(spark, "snk_05_06_saved_model_scores")
    assert scored and all(r["forecast_horizon_years"] == 1 and r["prediction"] == r["before_saving"] for r in scored)


def test_tuning_stages(spark):
    found = rows(spark, "ml_13_23_tuning")
    assert len(found) == 6 + 3 + 20 == len({r["params"] for r in found}) and sorted(r["stage"] for r in found if r["is_best"]) == ["coarse", "focused"]
    for stage in ("coarse", "focused"):
        assert min(r["rmse"] for r in found if r["stage"] == stage) == next(r["rmse"] for r in found if r["stage"] == stage and r["is_best"])
    assert len({r["rmse"] for r in found}) > 15


def test_grids_state_all_trees(spark, monkeypatch):
    from wearline.plans import model_queries, models

    asked = []
    monkeypatch.setattr(models, "grid", lambda *a, **_: asked.append(a[4]))
    monkeypatch.setattr(models, "grids", lambda *a, **_: (asked.append(a[4]), spark.range(1))[1])
    model_queries._tuning(None, None)
    monkeypatch.setattr(model_queries, "_split", lambda *_: (None, None, None))
    entry.queries()["ml_12_tree_grid"](spark, DATA)
    assert sorted(e.trees for tried in asked for e in tried.values() if hasattr(e, "trees")) == [100, 250, 300, 350]


def test_final_candidates_state_all_trees(spark, monkeypatch):
    from wearline.plans import model_queries, models

    asked = []

    class Enough(Exception):
        pass

    def seen(*a, **_):
        asked.append(a[4])
        if len(asked) == 2:
            raise Enough
        return spark.range(1)

    monkeypatch.setattr(models, "grid", seen)
    monkeypatch.setattr(model_queries, "_split", lambda *_: (None, None, None))
    with pytest.raises(Enough):
        entry.queries()["ml_14_16_17_src_04_snk_03_04_final_model"](spark, DATA)
    assert [e.trees for e in asked[1].values() if hasattr(e, "trees")] == [100]

"""The booster of the searches, and that the searches run all their trials."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog import models
from lapforge.plans import boosting, training

PARAMS = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample": 0.7, "min_child_weight": 20}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 900))
    y = np.where(a > 0.4, 2.0, -1.0) + b + rng.normal(scale=0.1, size=900)
    df = spark.createDataFrame([(*map(float, r), 1.0 + i % 3) for i, r in enumerate(zip(a, b, c, y))], "a double, b double, c double, y double, w double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).repartition(3).persist()


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]


def test_one_task_and_many_grow_the_same_trees(rows, monkeypatch):
    one = boosting.SearchBooster(PARAMS, label="y", weight="w").fit(rows)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    many = boosting.SearchBooster(PARAMS, label="y", weight="w").fit(rows)
    assert len(one.trees) == len(many.trees) == 7
    for s, t in zip(one.trees, many.trees):
        assert all(np.allclose(u, v, rtol=1e-9, atol=1e-9) for u, v in zip(s, t, strict=True))
    assert max(len(t[0]) for t in one.trees) <= 15


def test_a_tree_is_the_best_one_of_its_rows(rows):
    """One tree of one level on all rows: the split with the least squared error of all features and their 32 quantiles."""
    model = boosting.SearchBooster({**PARAMS, "n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample": 1.0, "learning_rate": 1.0}, label="y", weight="w").fit(rows)
    p = rows.select("a", "b", "c", "y", "w").toPandas()
    best = (np.inf,)
    for i, f in enumerate("abc"):
        for v in np.sort(p[f])[:-1:5]:
            sides = [p[p[f] <= v], p[p[f] > v]]
            best = min(best, (sum((s.w * (s.y - np.average(s.y, weights=s.w)) ** 2).sum() for s in sides), i, v))
    feature, threshold, _, value = model.trees[1]
    left, right = p[p["abc"[feature[0]]] <= threshold[0]], p[p["abc"[feature[0]]] > threshold[0]]
    assert feature[0] == best[1] and abs(threshold[0] - best[2]) < 0.1
    start = model.trees[0][3][0]
    assert start == pytest.approx(np.average(p.y, weights=p.w))
    np.testing.assert_allclose(value[1:], [np.average(s.y, weights=s.w) - start for s in (left, right)], atol=1e-9)


def test_leaves_hold_their_least_weight_and_more_trees_fit_better(rows):
    few, many = (boosting.SearchBooster({**PARAMS, "n_estimators": n}, label="y").fit(rows).transform(rows) for n in (2, 40))
    assert rmse(many) < 0.5 * rmse(few)
    alone = boosting.SearchBooster({**PARAMS, "min_child_weight": 451, "subsample": 1.0}, label="y").fit(rows)
    assert {len(t[0]) for t in alone.trees} == {1}
    with pytest.raises(ValueError, match="no rows"):
        boosting.SearchBooster(PARAMS, label="y").fit(rows.limit(0))


def test_the_global_search_runs_every_trial_of_the_full_ranges(spark, monkeypatch):
    tried = []

    def watched(df, features, params=None, *, estimator=None, **_):
        tried.append(estimator.settings if estimator is not None else params)
        return spark.createDataFrame([(float(len(tried)),)], "rmse double")

    monkeypatch.setattr(models, "_inputs", lambda *_: spark.createDataFrame([(1, 2.0)], "year int, LapNumber double"))
    monkeypatch.setattr(training, "evaluate_walk_forward", watched)
    assert models.model_search(spark, "").count() == len(tried) == 60
    assert {d["n_estimators"] for d in training.draw_params(K.GLOBAL_SEARCH)} == {d["n_estimators"] for d in tried}
    assert min(d["n_estimators"] for d in tried) >= 200 and max(d["max_depth"] for d in tried) > 6


def test_every_track_gets_every_trial_of_the_full_ranges(spark, monkeypatch):
    tried = []

    class Watched(boosting.SearchBooster):
        def __init__(self, params, **options):
            tried.append(dict(params))
            super().__init__({**params, "n_estimators": 2}, **options)

    rows = [(2000, models.TRACKS[i % 2], "R", i % 5, i, float(i % 7), float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "year int, gp string, session_code string, DriverNumber int, LapNumber int, TyreLife double, LapTimeResidual double")
    monkeypatch.setattr(models, "_inputs", lambda *_: df)
    monkeypatch.setattr(training, "SearchBooster", Watched)
    found = models.model_local_tracks(spark, "").toPandas()
    assert sorted(found["gp"]) == sorted(models.TRACKS[:2]) and (found.filter(like="rmse") > 0).all(axis=None)
    assert len(tried) == 2 * 20 and min(d["n_estimators"] for d in tried) >= 150 and max(d["max_depth"] for d in tried) > 6

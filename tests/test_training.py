import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.operators import splits
from lapforge.plans import stages, training
from lapforge.plans.features import build_features
from helpers import season

SHORT = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def features(spark):
    raw = spark.createDataFrame(season(4, ("A", "B", "C"), (2022, 2023, 2024), 20))
    return training.prepare(build_features(raw, "R")).persist()


def test_candidates_that_exist_in_order(features):
    names = training.available(features, K.GLOBAL_CANDIDATES)
    assert names[:4] == ["LapNumber", "Stint", "LapNumber_pct", "tyre_x_progress"] and "AirTemp" not in names
    with pytest.raises(ValueError, match="Missing|missing"):
        training.require_columns(features, ["nope"])


def test_walk_forward_reports_rows_and_gain(features):
    row = training.evaluate_walk_forward(features, ["LapNumber", "lap_time_prev", "TyreLife"], SHORT).first()
    assert row.train_rows == features.where("year < 2024").count() and row.test_rows == features.where("year = 2024").count()
    assert row.improvement_over_trivial == pytest.approx(1 - row.rmse / row.baseline_trivial_rmse)


def test_folds_report(features):
    folds = splits.leave_one_group_out(features)
    linear = lambda: LinearRegression(labelCol=K.TARGET, featuresCol="features")
    out = training.evaluate_folds(folds, ["lap_time_prev", "TyreLife"], linear, [1, 2, 3], fill_zero=True).orderBy("fold").collect()
    assert [r.test_gp for r in out] == ["A", "B", "C"]
    assert all(r.train_rows + r.test_rows == features.count() for r in out)


def test_search_is_seeded_and_sorted(spark):
    draws = training.draw_params(K.GLOBAL_SEARCH, trials=5)
    assert draws == training.draw_params(K.GLOBAL_SEARCH, trials=5) and all(3 <= d["max_depth"] <= 9 for d in draws)
    out = training.search(spark, draws, lambda p: p["learning_rate"]).collect()
    assert [r.rmse for r in out] == sorted(d["learning_rate"] for d in draws)


def test_final_model_survives_a_round_trip(spark, features, tmp_path):
    names = ["LapNumber", "lap_time_prev", "TyreLife"]
    model, encoder, inputs = training.final_fit(features, names, SHORT)
    assert inputs == [*names, "Driver_te", "Team_te", "gp_te"]
    importance = training.feature_importance(spark, model, inputs).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0) and importance[0].importance == max(r.importance for r in importance)
    training.save_model(model, encoder, str(tmp_path / "m"))
    loaded, tables = training.load_model(spark, str(tmp_path / "m"))
    a = training.score(features, model, encoder, names).agg(F.sum("prediction")).first()[0]
    b = training.score(features, loaded, tables, names).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b)


def test_local_ridge_matches_least_squares(features):
    names = ["LapNumber", "TyreLife", "lap_time_prev"]
    fits = {r.gp: r.coefficients for r in training.fit_local_linear(features, names, ridge=1e-9).collect()}
    p = features.where("gp = 'B'").select(*names, K.TARGET).toPandas().fillna(0.0)
    x = np.column_stack([np.ones(len(p)), p[["LapNumber", "lap_time_prev"]]])
    want = np.linalg.lstsq(x, p[K.TARGET], rcond=None)[0]
    scored = training.score_local_linear(features.where("gp = 'B'"), training.fit_local_linear(features, names, ridge=1e-9), names)
    got = scored.orderBy("year", "DriverNumber", "LapNumber").toPandas()["pred_local"]
    q = features.where("gp = 'B'").orderBy("year", "DriverNumber", "LapNumber").select("LapNumber", "lap_time_prev").toPandas().fillna(0.0)
    np.testing.assert_allclose(got, np.column_stack([np.ones(len(q)), q]) @ want, atol=1e-5)
    assert len(fits) == 3


def test_pit_classifier_learns_its_rule(spark):
    df = spark.range(200).select((F.col("id") % 40).cast("double").alias("TyreLife"), *[F.lit(1.0).alias(c) for c in K.PIT_FEATURES[1:]])
    model = training.pit_classifier(df, trees=5)
    scored = model.transform(training.doubles(df, K.PIT_FEATURES, fill_zero=True))
    assert scored.where((F.col("TyreLife") > 20) != (F.col("prediction") == 1)).count() == 0


def test_older_preparation_adds_codes(spark):
    df = spark.createDataFrame([(80.0, 0.1, 2024, "A", "R", "Red", " s "), (81.0, 0.2, 2024, "A", "Q", None, "H"), (82.0, None, 2024, "A", "R", "Blue", "?")],
                               "LapTime double, LapTimeResidual double, year int, gp string, session_code string, Team string, Compound string")
    out = {r.LapTime: r for r in training.prepare_leave_one_out(df).collect()}
    assert set(out) == {80.0, 81.0}
    assert (out[80.0].CompoundEncoded, out[80.0].team_encoded, out[81.0].team_encoded, out[80.0].session_code_encoded) == (0, 1, -1, 1)


@pytest.fixture(scope="module")
def encoded(spark):
    """Rows whose target depends on the driver and on x, with drivers that appear in one fold only."""
    rng = np.random.default_rng(3)
    n = 600
    driver, x = rng.integers(0, 12, n), rng.normal(size=n)
    y = driver * 0.5 + 0.8 * x + rng.normal(scale=0.3, size=n)
    fold = np.where(driver == 11, 2, rng.integers(0, 3, n))
    rows = [(f"D{d}" if d else None, f"T{d // 3}", float(a), float(b), int(f), float(s)) for d, a, b, f, s in zip(driver, x, y, fold, rng.permutation(y))]
    return spark.createDataFrame(rows, "Driver string, Team string, x double, y double, fold int, shuffled double")


def plain_fold_errors(rows, target="y", smoothing=5.0):
    out = []
    for k in range(3):
        train, test = rows[rows.fold != k], rows[rows.fold == k]
        overall = train[target].mean()
        columns = []
        for c in ("Driver", "Team"):
            stats = train.groupby(c)[target].agg(["sum", "count"])
            codes = (stats["sum"] + smoothing * overall) / (stats["count"] + smoothing)
            columns.append([part[c].map(codes).fillna(overall).to_numpy(float) for part in (train, test)])
        design = [np.c_[np.ones(len(part)), part.x, columns[0][i], columns[1][i]] for i, part in enumerate((train, test))]
        b = np.linalg.lstsq(design[0], train[target].to_numpy(), rcond=None)[0]
        out.append(np.sqrt(np.mean((test[target].to_numpy() - design[1] @ b) ** 2)))
    return out


def test_encoder_inside_cross_validation_sees_its_training_fold_only(encoded):
    pipeline = stages.encoded_regression(["x"], ["Driver", "Team"], target="y", smoothing=5.0)
    expected = plain_fold_errors(encoded.toPandas())
    got = stages.cross_validated(encoded, pipeline, 3, target="y").orderBy("fold").collect()
    np.testing.assert_allclose([r.rmse for r in got], expected, atol=1e-8)
    validated = stages.cross_validator(pipeline, 3, target="y").fit(encoded)
    assert validated.avgMetrics[0] == pytest.approx(np.mean(expected), abs=1e-8)
    poisoned = encoded.withColumn("y", F.when(F.col("fold") == 1, 1000.0).otherwise(F.col("y")))
    clean, spoiled = (pipeline.fit(d.where("fold <> 1")).transform(encoded.where("fold = 1")).agg(F.sum("prediction")).first()[0] for d in (encoded, poisoned))
    assert clean == spoiled


def test_models_beat_the_trivial_baseline_and_shuffled_targets_do_not(encoded):
    spread = encoded.agg(F.stddev_samp("y")).first()[0]
    makers = [None, training.booster({"n_estimators": 20, "max_depth": 3, "learning_rate": 0.2}, label="y")]
    for estimator in makers:
        found = stages.cross_validated(encoded.where("Driver <> 'D11'"), stages.encoded_regression(["x"], ["Driver", "Team"], target="y", estimator=estimator), 3, target="y")
        assert all(r.rmse < 0.5 * spread for r in found.collect())
    noise = stages.encoded_regression(["x"], ["Driver", "Team"], target="shuffled")
    assert all(r.rmse > 0.9 * spread for r in stages.cross_validated(encoded.where("Driver <> 'D11'"), noise, 3, target="shuffled").collect())


def test_encoder_model_survives_a_round_trip(encoded, tmp_path):
    fitted = stages.TargetEncoder(inputCols=["Driver", "Team"], outputCols=["d", "t"], labelCol="y", smoothing=3.0).fit(encoded)
    fitted.write().overwrite().save(str(tmp_path / "encoder"))
    loaded = stages.TargetEncoderModel.load(str(tmp_path / "encoder"))
    assert loaded.getOutputCols() == ["d", "t"] and loaded.getOrDefault("smoothing") == 3.0 and loaded.uid == fitted.uid
    a, b = (m.transform(encoded).orderBy("y").toPandas() for m in (fitted, loaded))
    assert a.equals(b) and list(a.columns[-2:]) == ["d", "t"]


def test_ridge_losses_equal_refits(spark):
    rng = np.random.default_rng(4)
    x, part = rng.normal(size=(500, 3)) * [1, 50, 0.1] + [0, 2000, 5], np.where(rng.random(500) < 0.7, "train", "test")
    y, w = x @ [0.5, -0.02, 3.0] + rng.normal(size=500), rng.integers(1, 4, 500).astype(float)
    rows = [(*map(float, r), float(t), p, float(v)) for r, t, p, v in zip(x, y, part, w)] + [(1.0, 1.0, 1.0, None, "train", 1.0), (1.0, 1.0, 1.0, 9.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, part string, w double")
    penalties = [0.0, 1.0, 100.0, 1e6]
    got = {r.penalty: r.rmse for r in training.ridge_losses(df, ["a", "b", "c"], penalties, target="y", weight="w").collect()}
    train, test = part == "train", part == "test"
    mean_x, mean_y = np.average(x[train], axis=0, weights=w[train]), np.average(y[train], weights=w[train])
    for penalty in penalties:
        xc, wt = x[train] - mean_x, w[train][:, None]
        b = np.linalg.solve(xc.T @ (wt * xc) + penalty * np.eye(3), xc.T @ (w[train] * (y[train] - mean_y)))
        assert got[penalty] == pytest.approx(np.sqrt(np.mean((y[test] - mean_y - (x[test] - mean_x) @ b) ** 2)), rel=1e-7)
    assert list(got.values()) == sorted(got.values())
    with pytest.raises(ValueError, match="training and test"):
        training.ridge_losses(df.where("part = 'train'"), ["a"], penalties, target="y")


def test_models_are_fitted_on_parts_of_bounded_size(spark, monkeypatch):
    """However many rows a partition of files holds; the parts hold the columns of the last stage only."""
    seen = []

    class Watched(LinearRegression):
        def fit(self, dataset, params=None):
            seen.append((dataset.columns, dataset.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]))
            return super().fit(dataset, params)

    df = spark.range(2000).selectExpr("id * 1.0D as a", "if(id % 9 = 0, null, id % 7 * 1.0D) as b", "id * 2.0D + id % 7 as y", "'x' as other").coalesce(1)
    pipeline = training.regression(["a", "b"], Watched(labelCol="y", featuresCol="features"))
    whole = pipeline.fit(df).transform(df).agg(F.sum("prediction")).first()[0]
    monkeypatch.setattr(training, "FIT_ROWS", 100)
    parts = training.fitted(pipeline, df).transform(df).agg(F.sum("prediction")).first()[0]
    assert seen[-1][0] == ["features", "y"] and seen[-1][1] <= 150 and abs(whole - parts) < 1e-6 * abs(whole)


def test_folds_are_fitted_on_written_parts_without_moving_rows(spark, monkeypatch):
    """A shuffle of the rows of every fold is what filled the disk; the parts are bounded as they are written."""
    seen = []

    class Watched(LinearRegression):
        def fit(self, dataset, params=None):
            sizes = dataset.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
            seen.append((sizes, dataset._jdf.queryExecution().executedPlan().toString().count("Exchange Round")))
            return super().fit(dataset, params)

    df = spark.range(3000).selectExpr("id % 3 as gp", "int(id % 3) + 1 as fold", "id % 17 * 1.0D as x", "id % 17 * 2.0D + id % 5 as y", "'unused' as other").coalesce(2)
    monkeypatch.setattr(training, "FIT_ROWS", 100)
    out = training.evaluate_folds(df, ["x"], lambda: Watched(labelCol="y", featuresCol="features"), [1, 2, 3], target="y", fill_zero=True).orderBy("fold").collect()
    assert [(r.test_gp, r.train_rows, r.test_rows) for r in out] == [(i, 2000, 1000) for i in range(3)]
    assert len(seen) == 3 and max(s for s, _ in seen) <= 100 and not any(n for _, n in seen)

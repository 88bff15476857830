import math

import pytest
from pyspark.sql import functions as F

from lapforge.operators import aggregates as A
from lapforge.plans import reports


def test_lap_telemetry_minimum_and_missing_brake(spark):
    rows = [(1, float(i), 50.0, None if i == 0 else 1.0, 9000.0, 4.0, 10.0 if i % 2 else 8.0) for i in range(10)] + [(2, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "lap int, Speed double, Throttle double, Brake double, RPM double, nGear double, DRS double")
    out = A.lap_telemetry(df, ["lap"]).collect()
    assert [r.lap for r in out] == [1] and out[0].brake_ratio == 0.9 and out[0].drs_ratio == 0.5
    simple = {r.lap: r for r in A.lap_telemetry_simple(df, ["lap"]).collect()}
    assert simple[1].drs_ratio == 1.0 and simple[2].speed_std is None


def test_live_change_skips_gaps(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([80.0, 81.0, None, 85.0, 84.0])], "k int, i int, LapTime double")
    full = df.withColumns({c: F.lit(1.0) for c in ("Speed", "Throttle", "Brake", "RPM", "nGear", "DRS")}).withColumn("ts", F.timestamp_seconds("i"))
    row = A.live_features(full, ["k"]).first()
    assert row.lap_time_mean_3 == 82.5 and row.lap_time_delta == 0.0


def test_metrics_and_zero_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 1.5), ("a", 3.0, 3.0), ("b", 5.0, 4.0), ("b", 5.0, 5.0)], "gp string, y double, pred double")
    m = {r.gp: r for r in A.error_metrics(df, ["gp"]).collect()}
    assert m["a"].rmse == pytest.approx(math.sqrt(0.5 / 3)) and m["a"].mae == pytest.approx(1 / 3) and m["a"].r2 == pytest.approx(0.75)
    assert m["b"].r2 is None
    base = A.trivial_baseline(df.where("gp = 'a'")).first()
    assert base.baseline_trivial_rmse == 1.0 and base.improvement_over_trivial == pytest.approx(1 - math.sqrt(0.5 / 3))


def test_folds(spark):
    folds = spark.createDataFrame([(1, "x", 0.5, 0.4, 0.1), (2, "y", 0.3, 0.2, 0.5), (3, "z", 0.3, 0.1, 0.6)],
                                  "fold int, test_gp string, rmse double, mae double, r2 double")
    assert A.best_fold(folds).first().best_group == "y"
    summary = A.fold_summary(folds).first()
    assert summary.rmse_mean == pytest.approx(1.1 / 3) and summary.rmse_std == pytest.approx(0.09428, abs=1e-5)


def test_importance_share(spark):
    rows = [(f"f{i}", v) for i, v in enumerate([0.4, 0.2, 0.1] + [0.03] * 10)]
    row = A.importance_share(spark.createDataFrame(rows, "feature string, importance double")).first()
    assert row.top3_pct == pytest.approx(70.0) and row.top10_pct == pytest.approx(91.0) and row.concentrated


def test_comparison_breaks_ties_for_the_global_model(spark):
    g = spark.createDataFrame([("A", 1.0, 0.5, 0.2), ("B", 2.0, 1.0, 0.1), ("C", 1.0, 1.0, 1.0)], "test_gp string, rmse double, mae double, r2 double")
    loc = spark.createDataFrame([("A", 0.5, 0.5, 0.3, 10), ("B", 3.0, 0.5, 0.1, 10)],
                                "gp string, rmse_local_optuna double, mae_local_optuna double, r2_local_optuna double, rows int")
    out = reports.compare_models(g, loc).collect()
    assert [r.gp for r in out] == ["A", "B"]
    assert (out[0].rmse_winner, out[0].mae_winner, out[0].r2_winner) == ("local_optuna", "global_optuna", "local_optuna")
    assert out[1].rmse_gain == -1.0 and out[1].r2_winner == "global_optuna"


def test_profiles(spark):
    df = spark.createDataFrame([(2023, "R", 1.0), (2023, "Q", None), (2024, "R", 2.0)], "year int, session_code string, AirTemp double")
    counts = {(r.year, r.session_code): r.n for r in A.row_counts(df).collect()}
    assert counts[(2023, None)] == 2 and counts[(2024, "R")] == 1 and (None, None) not in counts
    cover = A.coverage(df, ["AirTemp", "absent"]).collect()
    assert len(cover) == 1 and cover[0].non_null == 2
    assert A.table_shape(df).first()[:] == (3, 3)


def test_race_totals_add_pit_losses(spark):
    df = spark.createDataFrame([(1, 80.0, 0), (1, 82.0, 1)], "k int, LapTime double, pit int")
    row = A.race_totals(df, ["k"]).first()
    assert (row.total_time, row.mean_lap, row.pit_stops) == (182.0, 91.0, 1)

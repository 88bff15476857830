"""The feature plan on small seasons, against pandas, and the leakage properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.operators import history, quality
from lapforge.plans.features import build_features, session_statistics
from helpers import season, sorted_rows, stint

KEYS = [*K.LAP_GROUP, "LapNumber"]


def build(df):
    return history.derived_scores(history.telemetry_history(history.lap_time_history(df)))


@pytest.fixture(scope="module")
def laps(spark):
    return spark.createDataFrame(stint(30))


def test_lap_times_meet_the_fences_of_their_session_by_broadcast(spark):
    i = F.col("id")
    times = spark.range(600_000).select(
        F.lit(2024).alias("year"), (i % 3).cast("string").alias("gp"), F.lit("R").alias("session_code"),
        F.when(i % 50 == 0, 500.0).otherwise(80 + i % 1000 / 8 + i % 3).alias("LapTime"))
    out = session_statistics(times)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = {r.gp: (r._low, r._high, r.session_baseline) for r in out.collect()}
    for gp, values in times.toPandas().groupby("gp").LapTime:
        q1, q3 = np.quantile(values, [0.25, 0.75])
        low, high = q1 - K.IQR_FACTOR * (q3 - q1), q3 + K.IQR_FACTOR * (q3 - q1)
        assert got[gp] == pytest.approx((low, high, np.median(values[values.between(low, high)])))


def test_future_laps_do_not_move_earlier_features(laps):
    moved = quality.future_leaks(laps, build, from_lap=15, change=["LapTime", *K.TELEMETRY_COLUMNS])
    assert moved.count() > 20 and moved.agg(F.sum("changed")).first()[0] == 0


def test_a_leaking_feature_is_found(laps):
    def leaking(d):
        return d.join(d.groupBy(*K.LAP_GROUP).agg(F.avg("LapTime").alias("mean_prev")), K.LAP_GROUP)

    moved = quality.future_leaks(laps, leaking, from_lap=15, change=["LapTime"])
    assert moved.where("feature = 'mean_prev'").first().changed == 14


def test_first_lap_has_no_history(laps):
    names = ["lap_time_prev", "lap_time_mean_3_prev", "lap_time_delta_prev", "speed_mean_prev", "throttle_mean_prev", "brake_ratio_prev"]
    assert quality.first_lap_history(build(laps), names).agg(F.sum("filled")).first()[0] == 0
    first = build(laps).where("LapNumber = 1").first()
    assert first.degradation_score_prev == 0.0


def test_no_copy_of_the_target_and_exact_lag(laps):
    built = build(laps)
    assert quality.target_copies(built, quality.previous_features(built)).agg(F.sum("equal_rows")).first()[0] == 0
    assert quality.wrong_previous(built).first().wrong == 0
    assert quality.wrong_previous(built.withColumn("lap_time_prev", F.col("LapTime"))).first().wrong == 30


def test_progress_rises_to_one_and_products(spark):
    df = history.race_progress(spark.createDataFrame(stint(50)).withColumn("CompoundEncoded", F.lit(1.0)), "v3")
    clean = quality.progress_violations(df).first()
    assert (clean.outside, clean.not_rising, clean.unfinished) == (0, 0, 0)
    assert df.where("compound_x_tyre <> TyreLife").count() == 0
    bad = quality.progress_violations(df.withColumn("LapNumber_pct", F.lit(0.5))).first()
    assert bad.not_rising == 49 and bad.unfinished == 1


def test_zero_divisors_give_missing_values(spark):
    zero = spark.createDataFrame(stint(3)).withColumn("TyreLife", F.lit(0.0))
    assert history.tyre_and_stint(zero).where("tyre_ratio is not null").count() == 0


def expected_features(raw):
    """An independent pandas account of the plan for one session type."""
    p = raw.sort_values(KEYS).reset_index(drop=True)
    session = ["year", "gp", "session_code"]
    q = p.groupby(session)["LapTime"].quantile([0.25, 0.75]).unstack()
    p = p.join(q.rename(columns={0.25: "q1", 0.75: "q3"}), on=session)
    iqr = p["q3"] - p["q1"]
    p = p[(p["LapTime"] >= p["q1"] - 1.5 * iqr) & (p["LapTime"] <= p["q3"] + 1.5 * iqr)].reset_index(drop=True)
    p["residual"] = p["LapTime"] - p.groupby(session)["LapTime"].transform("median")
    p["prev"] = p.groupby(K.LAP_GROUP)["LapTime"].shift(1)
    p["pct"] = p["LapNumber"] / p.groupby(session)["LapNumber"].transform("max")
    race = p.groupby(["Driver", "year", "gp"])["residual"].mean().reset_index().sort_values(["Driver", "year", "gp"])
    race["form"] = race.groupby(["Driver", "year"])["residual"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    return p.merge(race[["Driver", "year", "gp", "form"]], on=["Driver", "year", "gp"])


@pytest.mark.parametrize("segment_rows", [4_000_000, 5])
def test_plan_matches_pandas(spark, segment_rows):
    raw = season()
    raw.loc[raw.index % 37 == 5, "LapTime"] += 40
    want = expected_features(raw)
    want = want[want["residual"].abs() <= 0.2].sort_values(KEYS).reset_index(drop=True)
    out = sorted_rows(build_features(spark.createDataFrame(raw), "R", max_residual=0.2, segment_rows=segment_rows), *KEYS)
    assert 0 < len(want) < len(raw) and len(out) == len(want)
    for got, name in (("LapTimeResidual", "residual"), ("lap_time_prev", "prev"), ("LapNumber_pct", "pct"), ("avg_residual_last_3_races", "form")):
        np.testing.assert_allclose(out[got], want[name], rtol=1e-9, atol=1e-9)
    assert (out["laps_since_neutralization"] >= 100).all()


def test_versions_and_errors(spark):
    df = spark.createDataFrame(season(2, ("A",), (2024,), 8))
    v3 = build_features(df, "R", version="v3")
    assert "LapNumber_pct" in v3.columns and "regulation_era" not in v3.columns
    with pytest.raises(ValueError):
        build_features(df, "R", version="v9")


def test_driver_missing_a_race(spark):
    raw = season(2, ("A", "B", "C", "D"), (2024,), 10)
    raw = raw[~((raw["DriverNumber"] == 1) & (raw["gp"] == "B"))]
    out = build_features(spark.createDataFrame(raw), "R", max_residual=100.0).toPandas()
    by = out.groupby(["DriverNumber", "gp"])[["LapTimeResidual", "avg_residual_last_3_races"]].mean()
    assert pd.isna(by.loc[(1, "A"), "avg_residual_last_3_races"])
    assert by.loc[(1, "C"), "avg_residual_last_3_races"] == pytest.approx(by.loc[(1, "A"), "LapTimeResidual"])

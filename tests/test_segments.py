"""Segmented windows against pandas, with groups whole and with groups cut into many segments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import history
from lapforge.operators.segments import group_position, open_segments, running_sum
from helpers import sorted_rows

KEYS = ["year", "gp", "session_code", "DriverNumber"]


@pytest.fixture(scope="module")
def laps():
    rng = np.random.default_rng(7)
    parts = []
    for driver, n in ((1, 1), (2, 2), (3, 40), (4, 400)):
        lap = np.sort(rng.choice(np.arange(1, 3 * n + 1), n, replace=False))
        parts.append(pd.DataFrame({
            "year": 2024, "gp": "A", "session_code": "R", "DriverNumber": driver, "LapNumber": lap,
            "LapTime": np.where(rng.random(n) < 0.2, np.nan, rng.integers(80 * 64, 90 * 64, n) / 64),
            "TyreLife": (np.arange(n) % 9 + 1).astype(float), "Stint": np.where(rng.random(n) < 0.2, np.nan, lap // 15),
            "is_neutralized": (rng.random(n) < 0.07).astype(int), "pit": (rng.random(n) < 0.1).astype(int),
        }))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, laps):
    df = spark.createDataFrame(laps)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("LapTime", "Stint")})


def reference(laps):
    p = laps.sort_values(KEYS + ["LapNumber"]).reset_index(drop=True)
    prev = p.groupby(KEYS)["LapTime"].shift(1)
    by = prev.groupby(p["DriverNumber"])
    p["mean3"] = by.transform(lambda s: s.rolling(3, min_periods=1).mean())
    p["std5"] = by.transform(lambda s: s.rolling(5, min_periods=2).std())
    p["prev"], p["delta"] = prev, by.diff()
    p["tyre_ratio"] = p["TyreLife"] / p.groupby(KEYS)["TyreLife"].transform("max")
    within = p.groupby(KEYS + ["Stint"])
    p["progress"] = (within.cumcount() + 1) / within["LapNumber"].transform("size")
    p.loc[p["Stint"].isna(), "progress"] = np.nan
    since = []
    for _, group in p.groupby(KEYS):
        count = 99
        for z in group["is_neutralized"]:
            count = 0 if z == 1 else count + 1
            since.append(count)
    p["since"] = since
    p["position"] = p.groupby(KEYS).cumcount() + 1
    cost = (p["LapTime"] + 20 * p["pit"]).fillna(0)
    p["total"] = cost.groupby(p["DriverNumber"]).cumsum()
    return p


@pytest.mark.parametrize("rows", [4_000_000, 50, 7, 3, 1])
def test_lap_history(frame, laps, rows):
    out = sorted_rows(history.lap_time_history(frame, rows=rows), "DriverNumber", "LapNumber")
    want = reference(laps)
    assert len(out) == len(want)
    for got, name in (("lap_time_prev", "prev"), ("lap_time_mean_3_prev", "mean3"), ("lap_time_delta_prev", "delta"),
                      ("lap_time_std_5_prev", "std5")):
        np.testing.assert_allclose(out[got], want[name], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("rows", [4_000_000, 50, 7, 1])
def test_tyre_stint_neutralization_totals(frame, laps, rows):
    want = reference(laps)
    tyre = sorted_rows(history.tyre_and_stint(frame, rows=rows), "DriverNumber", "LapNumber")
    np.testing.assert_allclose(tyre["tyre_ratio"], want["tyre_ratio"])
    np.testing.assert_allclose(tyre["stint_progress"], want["progress"])
    since = sorted_rows(history.laps_since_neutralization(frame, rows=rows), "DriverNumber", "LapNumber")
    assert since["laps_since_neutralization"].tolist() == want["since"].tolist()
    placed = sorted_rows(group_position(frame, KEYS, ["LapNumber"], "at", rows=rows), "DriverNumber", "LapNumber")
    assert placed["at"].tolist() == want["position"].tolist()
    cost = F.col("LapTime") + 20 * F.col("pit")
    total = sorted_rows(running_sum(frame, KEYS, ["LapNumber"], cost, "total", rows=rows), "DriverNumber", "LapNumber")
    known = ~total["total"].isna()
    np.testing.assert_allclose(total.loc[known, "total"], want.loc[known, "total"])


def test_known_neutralization_series(spark):
    rows = [(2024, "A", "R", 1, i + 1, z) for i, z in enumerate([0, 0, 1, 0, 0, 1, 0, 0])]
    df = spark.createDataFrame(rows, "year int, gp string, session_code string, DriverNumber int, LapNumber int, is_neutralized int")
    out = sorted_rows(history.laps_since_neutralization(df), "LapNumber")
    assert out["laps_since_neutralization"].tolist() == [100, 101, 0, 1, 2, 0, 1, 2]


def test_missing_group_key_gives_missing_history(spark):
    rows = [(2024, "A", "R", None, 1, 80.0), (2024, "A", "R", None, 2, 81.0)]
    df = spark.createDataFrame(rows, "year int, gp string, session_code string, DriverNumber int, LapNumber int, LapTime double")
    assert history.lap_time_history(df).where("lap_time_prev is not null").count() == 0


def test_ordinary_groups_need_one_shuffle_and_no_union(frame):
    plan = history.lap_time_history(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_all_rows_in_one_hot_group_at_one_order_value(spark):
    df = spark.createDataFrame([(1, 5, float(i)) for i in range(50)], "k int, o int, v double")
    s = open_segments(df, ["k"], ["o", "v"], rows=3, depth=2)
    assert s.close(s.frame).count() == 50


def test_clustered_order_values_still_give_even_segments(spark):
    """Half of the rows sit in a thousandth of the range."""
    values = [float(i) / 1000 for i in range(500)] + [float(i) for i in range(1, 501)]
    df = spark.createDataFrame([(1, v) for v in values], "k int, o double")
    s = open_segments(df, ["k"], ["o"], rows=100)
    sizes = [r["count"] for r in s.close(s.frame.withColumn("seg", F.col("_seg"))).groupBy("seg").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 5
    placed = sorted_rows(group_position(df, ["k"], ["o"], "at", rows=100), "o", "at")
    assert sorted(placed["at"]) == list(range(1, 1001))


@pytest.mark.parametrize("values", [
    [float(i) for i in range(999)] + [1e12], [5.0] * 1000, [7.0] * 500 + [float(i) for i in range(500)], [None] * 400 + [float(i) for i in range(600)],
], ids=["outlier", "one value", "half tied", "nulls"])
def test_segments_stay_within_twice_the_bound(spark, values):
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(values)], "k int, o double, v int")
    s = open_segments(df, ["k"], ["o"], rows=100)
    sizes = [r["count"] for r in s.frame.where("NOT _extra").groupBy("_seg").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 200
    placed = group_position(df, ["k"], ["o"], "at", rows=100).toPandas().sort_values("at")
    assert placed["at"].tolist() == list(range(1, 1001))
    known = placed["o"].dropna()
    assert known.is_monotonic_increasing and placed["o"].isna().tolist() == sorted(placed["o"].isna(), reverse=True)


def test_hot_groups_are_cut_before_the_first_shuffle(spark, frame):
    plan = history.lap_time_history(frame, rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("rows", [4_000_000, 9])
def test_missing_order_values_come_first(spark, rows):
    df = spark.createDataFrame([(1, None, float(i)) for i in range(3)] + [(1, i, float(i)) for i in range(40)], "k int, o int, v double")
    placed = group_position(df, ["k"], ["o", "v"], "at", rows=rows)
    assert {r["at"] for r in placed.where("o is null").collect()} == {1, 2, 3}
    assert {r["at"] for r in placed.collect()} == set(range(1, 44))


@pytest.mark.parametrize("pieces", [4_000_000, 60])
def test_small_segments_need_no_list_of_cuts(spark, frame, laps, monkeypatch, pieces):
    """Segments of few rows follow from positions, numbered piece by piece: every one is exactly full, no row carries a list."""
    monkeypatch.setattr("lapforge.operators.segments.PIECE_ROWS", pieces)
    s = open_segments(frame, KEYS, ["LapNumber"], rows=7, depth=5)
    assert "_cuts" not in s.frame._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in s.frame.where("NOT _extra AND DriverNumber = 4").groupBy("_seg").count().orderBy("_seg").collect()]
    assert sizes == [7] * 57 + [1]
    out = sorted_rows(history.lap_time_history(frame, rows=7), "DriverNumber", "LapNumber")
    want = reference(laps)
    np.testing.assert_allclose(out["lap_time_mean_3_prev"], want["mean3"], rtol=1e-9, atol=1e-7)
    np.testing.assert_allclose(out["lap_time_std_5_prev"], want["std5"], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("pieces", [4_000_000, 60])
def test_small_segments_keep_columns_of_any_name(spark, monkeypatch, pieces):
    monkeypatch.setattr("lapforge.operators.segments.PIECE_ROWS", pieces)
    df = spark.createDataFrame([(k, i // 3, -i, i) for k in range(2) for i in range(200)], "k int, _at int, _rows int, v int")
    placed = sorted_rows(group_position(df, ["k"], ["_at", "v"], "at", rows=4), "k", "v")
    assert placed["at"].tolist() == list(range(1, 201)) * 2 and (placed["_rows"] == -placed["v"]).all()

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import joins

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=float(seconds))


@pytest.mark.parametrize("rows", [4_000_000, 25, 4])
def test_nearest_matches_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    laps = [(s, i, at(rng.integers(0, 400))) for s in range(4) for i in range(60)] + [(0, 999, None)]
    weather = [(s, at(rng.integers(0, 400)), n, float(n)) for s in range(3) for n in range(40)]
    left = spark.createDataFrame(laps, "session int, lap int, start timestamp")
    right = spark.createDataFrame(weather, "session int, time timestamp, seq int, AirTemp double")
    out = joins.nearest_in_time(left, right, keys=["session"], left_time="start", right_time="time", values=["AirTemp"],
                                right_order="seq", rows=rows)
    got = {(r.session, r.lap): r.AirTemp for r in out.collect()}
    assert len(got) == len(laps)
    for session, lap, start in laps:
        options = [(abs((t - start).total_seconds()), t, n) for s, t, n, _ in weather if s == session] if start else []
        assert got[(session, lap)] == (float(min(options)[2]) if options else None)


def test_weather_without_rain_reading_counts_as_rain(spark):
    laps = spark.createDataFrame([(1, at(10))], "session int, LapStartTime timestamp")
    weather = spark.createDataFrame([(1, at(10), 20.0, None)], "session int, Time timestamp, AirTemp double, Rainfall boolean")
    assert joins.attach_weather(laps, weather, keys=["session"]).first().Rainfall == 1.0


MESSAGES = [
    (1, 1, None, "SafetyCar", "DEPLOYED", "SAFETY CAR DEPLOYED"),      # no lap: ignored
    (1, 2, 3, "Flag", None, "YELLOW IN SECTOR 2"),
    (1, 3, 5, "SafetyCar", "DEPLOYED", "SAFETY CAR DEPLOYED"),
    (1, 4, 7, "Other", None, "CAR 44 NOTED"),                          # state still on
    (1, 5, 8, "SafetyCar", "IN THIS LAP", "SAFETY CAR IN THIS LAP"),   # cleared before the lap is marked
    (1, 6, 9, "SafetyCar", "DEPLOYED", "VIRTUAL SAFETY CAR DEPLOYED"),
    (1, 7, 9, "SafetyCar", "ENDING", "VIRTUAL SAFETY CAR ENDING"),     # a set flag stays for the lap
    (1, 8, 12, "Flag", None, "CLEAR YELLOW"),
]


@pytest.mark.parametrize("rows", [4_000_000, 2])
def test_flags_follow_the_messages(spark, rows):
    df = spark.createDataFrame(MESSAGES, "session int, seq int, Lap int, Category string, Status string, Message string")
    flags = joins.lap_flags(df, keys=["session"], order=["seq"], rows=rows)
    got = {r.Lap: (r.is_sc, r.is_vsc, r.is_yellow) for r in flags.collect()}
    assert got == {3: (0, 0, 1), 5: (1, 0, 0), 7: (1, 0, 0), 8: (0, 0, 0), 9: (0, 1, 0), 12: (0, 0, 0)}
    carried = joins.lap_flags(df, keys=["session"], order=["seq"], carry_forward=True, rows=rows)
    by_lap = {r.Lap: r.is_sc for r in carried.collect()}
    assert sorted(by_lap) == list(range(3, 13)) and by_lap[6] == 1 and by_lap[4] == by_lap[10] == 0
    laps = spark.range(1, 15).select(F.lit(1).alias("session"), F.col("id").cast("int").alias("Lap"))
    assert joins.attach_flags(laps, flags, ["session", "Lap"]).where("is_sc is null").count() == 0


def test_quali_gap_and_races_only(spark):
    results = spark.createDataFrame(
        [(2024, 1, "A", 1, 71.0, 70.5, 70.0), (2024, 1, "B", 2, 71.5, 70.75, 0.0), (2024, 1, "C", None, None, None, None)],
        "year int, round int, Driver string, position int, Q1 double, Q2 double, Q3 double")
    got = {r.Driver: (r.quali_position, r.grid_position, r.gap_to_pole_ms) for r in joins.quali_results(results).collect()}
    assert got == {"A": (1, 1, 0.0), "B": (2, 2, 750.0), "C": (-1, -1, None)}
    laps = spark.createDataFrame([(2024, 1, "A", "R"), (2024, 1, "A", "Q")], "year int, round int, Driver string, session_code string")
    out = {r.session_code: r.quali_position for r in joins.attach_quali(laps, joins.quali_results(results)).collect()}
    assert out == {"R": 1, "Q": None}


def test_router_prefers_the_local_model(spark):
    scored = spark.createDataFrame([("Monaco Grand Prix", 1, 80.0), ("Spa", 2, 90.0)], "gp string, id int, pred_global double")
    local = spark.createDataFrame([("monaco_grand_prix", 1, 79.0)], "slug string, id int, pred_local double")
    out = {r.gp: (r.prediction, r.model_used) for r in joins.route_predictions(scored, local, row_id=["id"]).collect()}
    assert out == {"Monaco Grand Prix": (79.0, "local"), "Spa": (90.0, "global")}


def test_fastest_lap_trace(spark):
    laps = spark.createDataFrame([(1, 1, 80.0), (1, 2, 79.0), (1, 3, None)], "session int, lap int, LapTime double")
    samples = spark.createDataFrame(pd.DataFrame({"session": 1, "lap": [1, 2, 2, 3], "ts": range(4), "X": 1.0, "Y": 2.0}))
    assert {r.lap for r in joins.fastest_lap_trace(laps, samples, session=["session"], lap_key=["lap"]).collect()} == {2}


def test_small_tables_meet_the_laps_without_a_shuffle_of_the_laps(spark, tmp_path, monkeypatch):
    """One global line for all laps is a constant key: joined by a shuffle, every lap would meet in one task."""
    from lapforge.catalog import joins as catalog
    from lapforge.catalog import windows

    rows = spark.range(500).selectExpr(
        "2000 as year", "concat('NATION_', id % 5) as gp", "'R' as session_code", "id % 4 as DriverNumber", "concat('D', id % 4) as Driver", "cast(id as int) as LapNumber",
        "80 + id % 13 as LapTime", "id % 3 * 1.0D as LapTimeResidual", "1.0D as TyreLife", "0.5D as brake_ratio")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(catalog, "base_laps", lambda *_: rows)
        monkeypatch.setattr(windows, "_race_residuals", lambda *_: rows)
        spark.conf.set(limit, "-1")
        routed = catalog.join_route_predictions(spark, "")
        assert "SortMergeJoin [_all" not in routed._jdf.queryExecution().executedPlan().toString()
        spark.conf.set(limit, "20000")
        formed = windows.join_recent_form(spark, "")
        assert "SortMergeJoin" not in formed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set(limit, before)
    assert routed.count() == formed.count() == 500

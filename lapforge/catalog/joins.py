"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.registry import (
    KEY, RACE_CONTROL, SAMPLES, SPLIT_ROWS, TRACKS, base_sql, laps_sql, messages_sql, quali_sql, register, samples_sql, weather_sql,
)
from lapforge.catalog.windows import _STATE
from lapforge.catalog.filters import base_laps
from lapforge.functions import scalars as S
from lapforge.operators import aggregates, encoding, filters, joins
from lapforge.plans import ingest, training
from lapforge.session import written_table
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]

_NEAREST_BODY = """
SELECT session, lap_id, LapStartTime, AirTemp, TrackTemp, Humidity, Pressure, Rainfall, WindSpeed, WindDirection
FROM nearest WHERE rn = 1"""


def _weather(spark, sf_dir, **options):
    return joins.attach_weather(data.lap_starts(spark, sf_dir), data.weather(spark, sf_dir), keys=["session"], order="seq", **options)


@register("join_weather_nearest", weather_sql(_NEAREST_BODY))
def join_weather_nearest(spark, sf_dir):
    return _weather(spark, sf_dir)


@register("join_weather_nearest_split", weather_sql(_NEAREST_BODY))
def join_weather_nearest_split(spark, sf_dir):
    """The same join with the sessions cut into time segments."""
    return _weather(spark, sf_dir, rows=SPLIT_ROWS)


@register("join_lap_flags", messages_sql("""
SELECT l.session, l.event_id, l.Lap, coalesce(is_sc, 0) AS is_sc, coalesce(is_vsc, 0) AS is_vsc, coalesce(is_yellow, 0) AS is_yellow
FROM (SELECT user_id % 10 AS session, event_id, CAST((dayofmonth(ts) - 1) * 24 + hour(ts) AS INTEGER) AS Lap FROM events) l
LEFT JOIN flags f ON l.session = f.session AND l.Lap = f.Lap""", _STATE))
def join_lap_flags(spark, sf_dir):
    flags = joins.lap_flags(data.race_control(spark, sf_dir), keys=["session"], order=["ts", "seq"])
    laps = data.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("session"), "event_id",
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int").alias("Lap"))
    return joins.attach_flags(laps, flags, ["session", "Lap"]).select("session", "event_id", "Lap", "is_sc", "is_vsc", "is_yellow")


RESULTS_SQL = """
timed AS (SELECT *, coalesce(nullif(Q3, 0), nullif(Q2, 0), nullif(Q1, 0)) * 1000 AS best FROM quali),
results AS (SELECT year, round, Driver, CAST(coalesce(position, -1) AS INTEGER) AS quali_position,
  CAST(coalesce(position, -1) AS INTEGER) AS grid_position, best - min(best) OVER (PARTITION BY year, round) AS gap_to_pole_ms FROM timed)"""


@register("agg_pole_gap", quali_sql("SELECT * FROM results", RESULTS_SQL))
def agg_pole_gap(spark, sf_dir):
    return joins.quali_results(data.quali(spark, sf_dir))


@register("join_quali", quali_sql("""
SELECT laps.year, gp, session_code, DriverNumber, LapNumber, quali_position, grid_position, gap_to_pole_ms FROM laps LEFT JOIN results
  ON laps.year = results.year AND laps.round = results.round AND laps.Driver = results.Driver AND session_code = 'R'""", RESULTS_SQL))
def join_quali(spark, sf_dir):
    results = joins.quali_results(data.quali(spark, sf_dir))
    laps = data.laps(spark, sf_dir).select(*KEYS, "Driver", "round")
    return joins.attach_quali(laps, results).select(*KEYS, "quali_position", "grid_position", "gap_to_pole_ms")


@register("join_session_results", laps_sql("""
SELECT gp, rmse_a, rmse_b FROM (SELECT gp, avg(LapTime) AS rmse_a FROM laps WHERE session_code = 'R' GROUP BY gp) a
JOIN (SELECT gp, avg(LapTime) AS rmse_b FROM laps WHERE session_code = 'Q' AND gp <> 'NATION_0' GROUP BY gp) b USING (gp)"""))
def join_session_results(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    race = laps.where(F.col("session_code") == "R").groupBy("gp").agg(F.avg("LapTime").alias("rmse_a"))
    quali = laps.where((F.col("session_code") == "Q") & (F.col("gp") != "NATION_0")).groupBy("gp").agg(F.avg("LapTime").alias("rmse_b"))
    return race.join(quali, "gp")


@register("join_encoding_lookup", base_sql(f"""
SELECT {KEY}, coalesce(enc, gm) AS gp_te FROM laps LEFT JOIN (
  SELECT gp, (count(*) * avg(LapTime) + 20 * any_value(gm)) / (count(*) + 20) AS enc
  FROM base, (SELECT avg(LapTime) AS gm FROM base) g GROUP BY gp) e USING (gp), (SELECT avg(LapTime) AS gm FROM base) g2"""))
def join_encoding_lookup(spark, sf_dir):
    table = encoding.fit_target_encoding(base_laps(spark, sf_dir), "LapTime", "gp")
    return encoding.apply_target_encoding(data.laps(spark, sf_dir).select(*KEYS), "gp", table)


@register("join_route_predictions", base_sql(f"""
SELECT {KEY}, lower(gp) AS slug, round(coalesce(l.c + l.m * LapNumber, g.c + g.m * LapNumber), 6) AS prediction,
  CASE WHEN l.m IS NULL THEN 'global' ELSE 'local' END AS model_used
FROM base LEFT JOIN (SELECT gp AS track, regr_intercept(LapTime, LapNumber) AS c, regr_slope(LapTime, LapNumber) AS m FROM base
    WHERE gp IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_15', 'NATION_19') GROUP BY gp) l ON gp = track,
  (SELECT regr_intercept(LapTime, LapNumber) AS c, regr_slope(LapTime, LapNumber) AS m FROM base) g"""))
def join_route_predictions(spark, sf_dir):
    """Lines fitted to five tracks and to all laps; each lap gets its track's prediction, or else the global one."""
    laps = written_table(base_laps(spark, sf_dir).select(*KEYS, "LapTime").withColumn("_all", F.lit(1)), "routed-laps")

    def predicted(rows, group, output):
        # One row a track, or one in all: joined by a shuffle, all laps would meet in one task.
        fits = F.broadcast(training.local_fits(rows, group=group, x="LapNumber", y="LapTime"))
        return rows.join(fits, group).select(*KEYS, (F.col("intercept") + F.col("slope") * F.col("LapNumber")).alias(output))

    local = predicted(filters.in_tracks(laps, TRACKS), "gp", "pred_local").withColumn("slug", S.slug("gp"))
    routed = joins.route_predictions(predicted(laps, "_all", "pred_global"), local, row_id=KEYS)
    return routed.select(*KEYS, "slug", F.round("prediction", 6).alias("prediction"), "model_used")


@register("join_fastest_lap_trace", samples_sql("""
SELECT s.session, s.driver, s.lap, ts, X, Y FROM samples s JOIN (
  SELECT session, driver, lap FROM (
    SELECT session, driver, lap, row_number() OVER (PARTITION BY session ORDER BY LapTime, driver, lap) AS rn
    FROM (SELECT session, driver, lap, min(LapTime) AS LapTime FROM samples GROUP BY session, driver, lap HAVING min(LapTime) IS NOT NULL) m) r
  WHERE rn = 1) f ON s.session = f.session AND s.driver = f.driver AND s.lap = f.lap"""))
def join_fastest_lap_trace(spark, sf_dir):
    samples = data.telemetry_samples(spark, sf_dir)
    laps = samples.groupBy("session", "driver", "lap").agg(F.min("LapTime").alias("LapTime"))
    return joins.fastest_lap_trace(laps, samples, session=["session"], lap_key=["driver", "lap"])


@register("ingest_laps", weather_sql("""
SELECT n.session, n.lap_id, n.LapStartTime, speed_mean, rpm_mean, drs_ratio, AirTemp, Rainfall, WindSpeed,
  coalesce(is_sc, 0) AS is_sc, coalesce(is_vsc, 0) AS is_vsc, coalesce(is_yellow, 0) AS is_yellow
FROM nearest n JOIN (
  SELECT driver, avg(Speed) AS speed_mean, avg(RPM) AS rpm_mean, avg(CASE WHEN DRS >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS drs_ratio
  FROM samples GROUP BY driver HAVING count(*) >= 10) t ON n.user_id = t.driver
LEFT JOIN flags f ON n.session = f.session AND n.LapNumber = f.Lap
WHERE rn = 1""", SAMPLES, RACE_CONTROL, _STATE))
def ingest_laps(spark, sf_dir):
    """Clicks are laps; the samples of a lap are all events of its user."""
    events = data.table(spark, sf_dir, "events")
    samples = data.telemetry_samples(spark, sf_dir).select("session", "driver", "Speed", "Throttle", "Brake", "RPM", "nGear", "DRS")
    clicks = events.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("lap_id"), F.col("user_id").alias("driver"),
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int").alias("LapNumber"))
    laps = data.lap_starts(spark, sf_dir).join(clicks, "lap_id")
    out = ingest.assemble(
        laps, samples, data.weather(spark, sf_dir).drop("Pressure"), data.race_control(spark, sf_dir), session=["session"],
        lap_key=["driver"], message_order=["ts", "seq"])
    return out.select("session", "lap_id", "LapStartTime", "speed_mean", "rpm_mean", "drs_ratio", "AirTemp", "Rainfall",
                      "WindSpeed", "is_sc", "is_vsc", "is_yellow")

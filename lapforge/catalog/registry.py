"""Registered queries and the SQL each of them is checked against, with the shared SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EXCLUDED = ["NATION_0"]
ERAS = {1999: 0, 2000: 1, 2001: 2}
WEIGHTS = {1999: 1.0, 2000: 2.0}
TRAIN_YEARS = [1999, 2000]
TEST_YEAR = 2001
TRACKS = ["NATION_3", "NATION_7", "NATION_11", "NATION_15", "NATION_19"]


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same rows in ANSI SQL."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


#: Rows to a segment, or values to a group, in the ``*_split`` queries: so few that they take the path of hot groups.
SPLIT_LAPS, SPLIT_ROWS = 5, 20


_LAPS = """
laps AS (
  SELECT year, gp, round, session_code, DriverNumber, 'D' || DriverNumber AS Driver,
    'T' || (DriverNumber // 2) AS Team, LapNumber,
    CASE WHEN l_partkey % 101 <> 0 THEN CASE WHEN l_orderkey % 97 = 0 THEN CAST(160 AS DOUBLE)
      ELSE 80 + floor(l_extendedprice / 8) / 1024 END END AS LapTime,
    CASE WHEN l_linenumber = 1 AND l_orderkey % 11 = 0 THEN CAST(1 AS DOUBLE) END AS PitInTime,
    CASE WHEN l_linenumber = 2 AND l_orderkey % 11 = 0 THEN CAST(1 AS DOUBLE) END AS PitOutTime,
    CASE WHEN l_orderkey % 13 <> 0 THEN disc >= 10 END AS Deleted,
    CASE l_linenumber WHEN 1 THEN 'SOFT' WHEN 2 THEN 'medium' WHEN 3 THEN 'HARD' WHEN 4 THEN 'INTERMEDIATE'
      WHEN 5 THEN 'WET' WHEN 6 THEN 'TEST' END AS Compound,
    CASE WHEN l_linenumber <> 7 THEN CAST(1 + (LapNumber - 1) // 8 AS INTEGER) END AS Stint,
    CAST((LapNumber - 1) % 8 + 1 AS DOUBLE) AS TyreLife,
    CAST(1 + l_partkey % 20 AS DOUBLE) AS Position,
    CAST(1 + l_suppkey % 7 AS VARCHAR) AS TrackStatus,
    CASE WHEN l_partkey % 103 <> 0 THEN 150 + l_quantity END AS speed_mean,
    250 + l_quantity AS speed_max, l_quantity / 8 AS speed_std,
    40 + tax AS throttle_mean, disc / 4 AS throttle_std, disc / 64 AS brake_ratio,
    9000 + l_quantity * 16 AS rpm_mean, 4 + l_quantity / 16 AS gear_mean, tax / 64 AS drs_ratio,
    CAST(l_partkey % 13 = 0 AS INTEGER) AS is_sc, CAST(l_partkey % 17 = 0 AS INTEGER) AS is_vsc,
    CAST(l_partkey % 11 = 0 AS INTEGER) AS is_yellow,
    20 + l_quantity / 8 AS AirTemp, 30 + tax * 2 AS TrackTemp,
    CAST(40 + l_linenumber AS DOUBLE) AS Humidity, CAST(1000 + l_partkey % 32 AS DOUBLE) AS Pressure,
    CAST(CAST(l_linestatus = 'F' AS INTEGER) AS DOUBLE) AS Rainfall,
    l_quantity / 16 AS WindSpeed, CAST(l_partkey % 360 AS DOUBLE) AS WindDirection
  FROM (
    SELECT *, CAST(row_number() OVER (
        PARTITION BY year, gp, session_code, DriverNumber
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
          l_discount, l_tax, l_linestatus) AS INTEGER) AS LapNumber
    FROM (
      SELECT CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS gp, n_nationkey AS round,
        CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'Q' ELSE 'T' END AS session_code,
        CAST(l_suppkey % 10 AS INTEGER) AS DriverNumber,
        round(l_tax * 100) AS tax, round(l_discount * 100) AS disc, lineitem.*
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey) keyed) placed)"""

_BASE = """
base AS (
  SELECT * FROM laps WHERE PitOutTime IS NULL AND PitInTime IS NULL AND NOT coalesce(Deleted, false)
    AND gp <> 'NATION_0' AND LapTime IS NOT NULL)"""

_KEPT = """
fences AS (
  SELECT year, gp, session_code, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
  FROM (SELECT year, gp, session_code, quantile_cont(LapTime, 0.25) AS q1, quantile_cont(LapTime, 0.75) AS q3
        FROM base GROUP BY ALL) q),
kept AS (
  SELECT base.* FROM base JOIN fences USING (year, gp, session_code) WHERE LapTime BETWEEN low AND high)"""

_EVENTS = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

SAMPLES = f"""
samples AS (
  SELECT session, driver, lap, ts, event_id, Speed, CAST(k AS DOUBLE) AS Throttle,
    CASE WHEN k % 10 <> 9 THEN CAST(CAST(event_type = 'error' AS INTEGER) AS DOUBLE) END AS Brake,
    CAST(9000 + floor(value) * 16 AS DOUBLE) AS RPM, CAST(k % 8 AS DOUBLE) AS nGear, CAST(k % 15 AS DOUBLE) AS DRS,
    CASE WHEN k % 5 = 0 THEN 80 + floor(value) / 16 END AS LapTime, floor(value * 4) / 4 AS X, k / 4 AS Y
  FROM (SELECT *, user_id % 10 AS session, user_id AS driver, CAST((dayofmonth(ts) - 1) // 10 AS INTEGER) AS lap,
          floor(value * 16) / 16 AS Speed, {_EVENTS} AS k FROM events) e)"""

QUALI_SQL = """
quali AS (
  SELECT year, gp, round, Driver,
    CASE WHEN Driver <> 'D9' THEN length(gp) % 10 + CAST(substr(Driver, 2, 1) AS INTEGER) END AS position,
    Q1, Q2, CASE WHEN Driver = 'D3' THEN CAST(0 AS DOUBLE) WHEN Driver <> 'D7' THEN q3x END AS Q3
  FROM (SELECT year, gp, round, Driver, min(LapTime) FILTER (WHERE LapNumber % 3 = 1) AS Q1,
          min(LapTime) FILTER (WHERE LapNumber % 3 = 2) AS Q2, min(LapTime) FILTER (WHERE LapNumber % 3 = 0) AS q3x
        FROM laps WHERE session_code = 'Q' AND LapTime IS NOT NULL GROUP BY year, gp, round, Driver) d)"""

RACE_CONTROL = f"""
messages AS (
  SELECT user_id % 10 AS session, ts, event_id AS seq,
    CASE WHEN event_id % 50 <> 0 THEN CAST((dayofmonth(ts) - 1) * 24 + hour(ts) AS INTEGER) END AS Lap,
    CASE WHEN event_type IN ('error', 'signup') THEN 'SafetyCar' ELSE 'Flag' END AS Category,
    CASE WHEN event_type = 'error' THEN 'DEPLOYED' WHEN event_type = 'signup' AND k % 3 = 0 THEN 'ENDING' END AS Status,
    CASE WHEN event_type = 'error' THEN v || 'Safety Car deployed' WHEN event_type = 'signup' THEN v || 'Safety Car in this lap'
      WHEN event_type = 'purchase' THEN 'Yellow in sector' WHEN event_type = 'click' THEN 'Clear yellow' END AS Message
  FROM (SELECT *, {_EVENTS} AS k, CASE WHEN {_EVENTS} % 2 = 1 THEN 'Virtual ' ELSE '' END AS v FROM events) e)"""

_WEATHER = f"""
starts AS (
  SELECT user_id % 10 AS session, user_id, event_id AS lap_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS LapStartTime,
    CAST((dayofmonth(ts) - 1) * 24 + hour(ts) AS INTEGER) AS LapNumber
  FROM events WHERE event_type = 'click'),
weather AS (
  SELECT user_id % 9 AS session, ts AS Time, event_id AS seq, value AS AirTemp, value + 10 AS TrackTemp,
    CAST(k AS DOUBLE) AS Humidity, CAST(1000 + k AS DOUBLE) AS Pressure,
    CASE WHEN k % 10 = 3 THEN CAST(1 AS DOUBLE) ELSE CAST(CAST(k % 2 = 0 AS INTEGER) AS DOUBLE) END AS Rainfall,
    k / 8 AS WindSpeed, CAST(k * 3 AS DOUBLE) AS WindDirection
  FROM (SELECT *, {_EVENTS} AS k FROM events WHERE event_type = 'view') e)"""

_NEAREST = """
nearest AS (
  SELECT s.*, w.AirTemp, w.TrackTemp, w.Humidity, w.Pressure, w.Rainfall, w.WindSpeed,
    w.WindDirection,
    row_number() OVER (PARTITION BY s.session, s.lap_id
      ORDER BY abs(epoch_us(w.Time) - epoch_us(s.LapStartTime)), w.Time, w.seq) AS rn
  FROM starts s LEFT JOIN weather w ON s.session = w.session AND s.LapStartTime IS NOT NULL)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",".join(v for v in views if v) + " " + body


def laps_sql(body: str, *views: str) -> str:
    return with_views(body, _LAPS, *views)


def base_sql(body: str, *views: str) -> str:
    """Laps after the basic filter."""
    return with_views(body, _LAPS, _BASE, *views)


def kept_sql(body: str, *views: str) -> str:
    """Laps after the basic filter and the outlier fences."""
    return with_views(body, _LAPS, _BASE, _KEPT, *views)


def copies_sql(body: str, copies: str, *views: str) -> str:
    """The filters over ``copies``, which makes the view ``laps`` from the laps as they are, named ``raw``."""
    return with_views(body, _LAPS.replace("laps AS", "raw AS", 1), copies, _BASE, _KEPT, *views)


def quali_sql(body: str, *views: str) -> str:
    return with_views(body, _LAPS, QUALI_SQL, *views)


def samples_sql(body: str, *views: str) -> str:
    return with_views(body, SAMPLES, *views)


def messages_sql(body: str, *views: str) -> str:
    return with_views(body, RACE_CONTROL, *views)


def weather_sql(body: str, *views: str) -> str:
    return with_views(body, _WEATHER, _NEAREST, *views)


KEY = "year, gp, session_code, DriverNumber, LapNumber"
DRIVER = "PARTITION BY year, gp, session_code, DriverNumber"
LAP_WINDOW = f"WINDOW g AS ({DRIVER} ORDER BY LapNumber)"

"""The whole feature plan, race and qualifying, current and older version."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.joins import RESULTS_SQL
from lapforge.catalog.registry import DRIVER, ERAS, EXCLUDED, LAP_WINDOW, QUALI_SQL, SPLIT_LAPS, kept_sql, register
from lapforge.catalog.scalars import COMPOUND_SQL
from lapforge.catalog.windows import HISTORY_SQL, NEUTRAL_SQL, TELEMETRY_SQL, TYRE_SQL
from lapforge.operators import joins
from lapforge.plans import features, ingest
from lapforge.plans.reports import feature_coverage
from lapforge.sources import testdata as data

_SCORES = """coalesce(lap_time_delta_prev, 0) - coalesce(speed_mean_delta_prev, 0) + coalesce(brake_ratio_prev, 0) AS degradation_score_prev,
  throttle_mean_prev * (1 - brake_ratio_prev) AS aggression_score_prev, speed_mean_prev / (rpm_mean_prev + 1) AS efficiency_score_prev,
  drs_ratio_prev * speed_max_prev AS drs_usage_intensity_prev, lap_time_std_5_prev AS consistency_score_prev,
  LapNumber / race_laps AS LapNumber_pct, TyreLife * (LapNumber / race_laps) AS tyre_x_progress,
  CompoundEncoded * TyreLife AS compound_x_tyre"""
_RESIDUAL = f"""median(LapTime) OVER (PARTITION BY year, gp, session_code) AS session_baseline,
  LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS LapTimeResidual, CAST({COMPOUND_SQL} AS DOUBLE) AS CompoundEncoded"""


def _v4(session: str, limit: int) -> tuple[str, ...]:
    return (f"""
z AS (
  SELECT *, {_RESIDUAL}, CAST(is_sc = 1 OR is_vsc = 1 AS INTEGER) AS is_neutralized, TrackTemp - AirTemp AS temp_delta,
    CAST(CASE year WHEN 1999 THEN 0 WHEN 2000 THEN 1 WHEN 2001 THEN 2 ELSE -1 END AS DOUBLE) AS regulation_era
  FROM kept WHERE session_code = '{session}'),
h AS (
  SELECT *, is_neutralized AS z, {HISTORY_SQL}, {TELEMETRY_SQL}, {TYRE_SQL}, row_number() OVER g AS rn,
    max(LapNumber) OVER (PARTITION BY year, gp, session_code) AS race_laps FROM z {LAP_WINDOW}),
form AS (
  SELECT Driver, year, gp, round(avg(m) OVER (PARTITION BY Driver, year ORDER BY gp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 9)
    AS avg_residual_last_3_races FROM (SELECT Driver, year, gp, avg(LapTimeResidual) AS m FROM z GROUP BY ALL) r),
features AS (
  SELECT * EXCLUDE (z, rn, race_laps) FROM (SELECT *, {NEUTRAL_SQL} AS laps_since_neutralization, {_SCORES} FROM h) s
  LEFT JOIN form USING (Driver, year, gp) WHERE abs(LapTimeResidual) <= {limit})""",)


RACE_FEATURES_SQL = _v4("R", 3)
_V3 = (f"""
z AS (SELECT *, {_RESIDUAL} FROM kept WHERE session_code = 'R'),
h AS (SELECT *, {HISTORY_SQL}, {TELEMETRY_SQL}, {TYRE_SQL}, max(LapNumber) OVER ({DRIVER}) AS race_laps FROM z {LAP_WINDOW}),
features AS (SELECT * EXCLUDE (race_laps) FROM (SELECT *, {_SCORES} FROM h) s WHERE abs(LapTimeResidual) <= 3)""",)


def race_features(spark, sf_dir, session="R", version="v4", **options):
    return features.build_features(
        data.laps(spark, sf_dir), session, version=version, excluded=EXCLUDED, eras=ERAS, **options)


def _tidy(df):
    digits = {"lap_time_std_5_prev": 6, "consistency_score_prev": 6, "avg_residual_last_3_races": 9}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


@register("features_race_v4", kept_sql("SELECT * FROM features", *_v4("R", 3)))
def features_race_v4(spark, sf_dir):
    return _tidy(race_features(spark, sf_dir))


@register("features_race_v4_split", kept_sql("SELECT * FROM features", *_v4("R", 3)))
def features_race_v4_split(spark, sf_dir):
    """The same features with driver sessions above a few laps treated as hot ones."""
    return _tidy(race_features(spark, sf_dir, segment_rows=SPLIT_LAPS))


@register("features_quali_v4", kept_sql("SELECT * FROM features", *_v4("Q", 5)))
def features_quali_v4(spark, sf_dir):
    return _tidy(race_features(spark, sf_dir, "Q"))


@register("features_race_v3", kept_sql("SELECT * FROM features", *_V3))
def features_race_v3(spark, sf_dir):
    return _tidy(race_features(spark, sf_dir, version="v3"))


_COVERED = ["regulation_era", "is_sc", "is_vsc", "is_neutralized", "laps_since_neutralization", "AirTemp", "TrackTemp", "temp_delta",
            "Rainfall", "avg_residual_last_3_races"]


@register("features_coverage", kept_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows, 100 * count({c}) / count(*) AS pct FROM features"
    for c in _COVERED), *_v4("R", 3)))
def features_coverage(spark, sf_dir):
    return feature_coverage(race_features(spark, sf_dir))


_DRESSED = (*_v4("R", 3), QUALI_SQL, RESULTS_SQL, """
dressed AS (SELECT f.*, quali_position, grid_position, gap_to_pole_ms FROM features f LEFT JOIN results r
  ON f.year = r.year AND f.round = r.round AND f.Driver = r.Driver)""")


def _with_quali(spark, sf_dir):
    """Raw laps with defaults, qualifying results of the event, then the whole feature plan."""
    laps = ingest.lap_rows(data.laps(spark, sf_dir))
    dressed = joins.attach_quali(laps, joins.quali_results(data.quali(spark, sf_dir)))
    return features.build_features(dressed, "R", excluded=EXCLUDED, eras=ERAS)


@register("features_with_quali", kept_sql("SELECT * EXCLUDE (Deleted, Stint), CAST(Stint AS DOUBLE) AS Stint FROM dressed", *_DRESSED))
def features_with_quali(spark, sf_dir):
    return _tidy(_with_quali(spark, sf_dir)).drop("Deleted")


@register("features_coverage_with_quali", kept_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows, 100 * count({c}) / count(*) AS pct FROM dressed"
    for c in K.COVERAGE_COLUMNS), *_DRESSED))
def features_coverage_with_quali(spark, sf_dir):
    return feature_coverage(_with_quali(spark, sf_dir))

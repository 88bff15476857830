"""Ordered features of a driver session, form, race-control state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.filters import base_laps
from lapforge.catalog.registry import (
    DRIVER, KEY, LAP_WINDOW, base_sql, SPLIT_LAPS, SPLIT_ROWS, kept_sql, laps_sql, messages_sql, register,
)
from lapforge.catalog.scalars import COMPOUND_SQL
from lapforge.functions import scalars as S
from lapforge.operators import aggregates, filters, history, joins
from lapforge.plans import features
from lapforge.session import written_table
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]

HISTORY_SQL = """lag(LapTime) OVER g AS lap_time_prev,
  avg(LapTime) OVER (g ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lap_time_mean_3_prev,
  lag(LapTime) OVER g - lag(LapTime, 2) OVER g AS lap_time_delta_prev,
  round(stddev_samp(LapTime) OVER (g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS lap_time_std_5_prev"""
TELEMETRY_SQL = ",\n  ".join(
    f"lag({c}) OVER g AS {c}_prev, lag({c}) OVER g - lag({c}, 2) OVER g AS {c}_delta_prev" for c in K.TELEMETRY_COLUMNS)


@register("window_lap_history", laps_sql(f"SELECT {KEY}, {HISTORY_SQL} FROM laps {LAP_WINDOW}"))
def window_lap_history(spark, sf_dir):
    out = history.lap_time_history(data.laps(spark, sf_dir).select(*KEYS, "LapTime")).drop("LapTime")
    return out.withColumn("lap_time_std_5_prev", F.round("lap_time_std_5_prev", 6))


@register("window_lap_history_split", laps_sql(f"SELECT {KEY}, {HISTORY_SQL} FROM laps {LAP_WINDOW}"))
def window_lap_history_split(spark, sf_dir):
    """The same history with groups above a few laps treated as hot ones."""
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime")
    out = history.lap_time_history(laps, rows=SPLIT_LAPS).drop("LapTime")
    return out.withColumn("lap_time_std_5_prev", F.round("lap_time_std_5_prev", 6))


@register("window_telemetry_history", laps_sql(f"SELECT {KEY},\n  {TELEMETRY_SQL} FROM laps {LAP_WINDOW}"))
def window_telemetry_history(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, *K.TELEMETRY_COLUMNS)
    return history.telemetry_history(laps).drop(*K.TELEMETRY_COLUMNS)


@register("scalar_history_scores", laps_sql(f"""
SELECT {KEY}, coalesce(lap_time_delta_prev, 0) - coalesce(speed_mean_delta_prev, 0) + coalesce(brake_ratio_prev, 0) AS degradation_score_prev,
  throttle_mean_prev * (1 - brake_ratio_prev) AS aggression_score_prev, speed_mean_prev / (rpm_mean_prev + 1) AS efficiency_score_prev,
  drs_ratio_prev * speed_max_prev AS drs_usage_intensity_prev, lap_time_std_5_prev AS consistency_score_prev
FROM (SELECT {KEY}, {HISTORY_SQL}, {TELEMETRY_SQL} FROM laps {LAP_WINDOW}) h"""))
def scalar_history_scores(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime", *K.TELEMETRY_COLUMNS)
    scored = history.derived_scores(history.telemetry_history(history.lap_time_history(laps)))
    return scored.select(
        *KEYS, "degradation_score_prev", "aggression_score_prev", "efficiency_score_prev", "drs_usage_intensity_prev",
        F.round("consistency_score_prev", 6).alias("consistency_score_prev"))


TYRE_SQL = f"""TyreLife / nullif(max(TyreLife) OVER ({DRIVER}), 0) AS tyre_ratio,
  CASE WHEN Stint IS NOT NULL THEN row_number() OVER ({DRIVER}, Stint ORDER BY LapNumber) / count(*) OVER ({DRIVER}, Stint) END
    AS stint_progress"""


@register("window_tyre_and_stint", base_sql(f"SELECT {KEY}, {TYRE_SQL} FROM base"))
def window_tyre_and_stint(spark, sf_dir):
    laps = base_laps(spark, sf_dir).select(*KEYS, "TyreLife", "Stint")
    return history.tyre_and_stint(laps).drop("TyreLife", "Stint")


@register("window_session_baseline", kept_sql(f"""
SELECT {KEY}, median(LapTime) OVER (PARTITION BY year, gp, session_code) AS session_baseline,
  LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS LapTimeResidual FROM kept"""))
def window_session_baseline(spark, sf_dir):
    kept = filters.iqr_filter(base_laps(spark, sf_dir))
    return features.session_baseline(kept).select(*KEYS, "session_baseline", "LapTimeResidual")


@register("window_session_baseline_split", kept_sql(f"""
SELECT {KEY}, median(LapTime) OVER (PARTITION BY year, gp, session_code) AS session_baseline,
  LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS LapTimeResidual FROM kept"""))
def window_session_baseline_split(spark, sf_dir):
    kept = filters.iqr_filter(base_laps(spark, sf_dir))
    return features.session_baseline(kept, rows=SPLIT_ROWS).select(*KEYS, "session_baseline", "LapTimeResidual")


def _progress_sql(scope: str) -> str:
    return laps_sql(f"""
SELECT {KEY}, pct AS LapNumber_pct, TyreLife * pct AS tyre_x_progress, CAST({COMPOUND_SQL} AS DOUBLE) * TyreLife AS compound_x_tyre
FROM (SELECT *, LapNumber / max(LapNumber) OVER (PARTITION BY {scope}) AS pct FROM laps) p""")


def _progress(spark, sf_dir, version):
    laps = data.laps(spark, sf_dir).select(*KEYS, "TyreLife", S.compound_code().alias("CompoundEncoded"))
    return history.race_progress(laps, version).drop("TyreLife", "CompoundEncoded")


@register("window_race_progress", _progress_sql("year, gp, session_code"))
def window_race_progress(spark, sf_dir):
    return _progress(spark, sf_dir, "v4")


@register("window_driver_progress", _progress_sql("year, gp, session_code, DriverNumber"))
def window_driver_progress(spark, sf_dir):
    return _progress(spark, sf_dir, "v3")


_RESIDUALS = """
residuals AS (SELECT *, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS LapTimeResidual
  FROM kept WHERE session_code = 'R'),
races AS (SELECT Driver, year, gp, round, avg(LapTimeResidual) AS mean_residual FROM residuals GROUP BY ALL)"""


def _race_residuals(spark, sf_dir):
    return features.surviving_laps(filters.session_is(base_laps(spark, sf_dir), "R"))


@register("agg_race_residual", kept_sql("SELECT Driver, year, gp, mean_residual FROM races", _RESIDUALS))
def agg_race_residual(spark, sf_dir):
    return aggregates.race_residuals(_race_residuals(spark, sf_dir))


_FORM = "avg(mean_residual) OVER (PARTITION BY Driver, year ORDER BY {} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@register("window_recent_form", kept_sql(f"""
SELECT Driver, year, gp, round({_FORM.format('gp')}, 9) AS avg_residual_last_3_races FROM races""", _RESIDUALS))
def window_recent_form(spark, sf_dir):
    form = aggregates.recent_form(aggregates.race_residuals(_race_residuals(spark, sf_dir)))
    return form.select("Driver", "year", "gp", F.round("avg_residual_last_3_races", 9).alias("avg_residual_last_3_races"))


@register("window_recent_form_calendar", kept_sql(f"""
SELECT Driver, year, gp, round({_FORM.format('round')}, 9) AS avg_residual_last_3_races FROM races""", _RESIDUALS))
def window_recent_form_calendar(spark, sf_dir):
    laps = _race_residuals(spark, sf_dir)
    races = laps.groupBy("Driver", "year", "gp", "round").agg(F.avg("LapTimeResidual").alias("mean_residual"))
    form = aggregates.recent_form(races, order="round")
    return form.select("Driver", "year", "gp", F.round("avg_residual_last_3_races", 9).alias("avg_residual_last_3_races"))


@register("join_recent_form", kept_sql(f"""
SELECT {KEY}, round(avg_residual_last_3_races, 9) AS avg_residual_last_3_races FROM residuals LEFT JOIN (
  SELECT Driver, year, gp, {_FORM.format('gp')} AS avg_residual_last_3_races FROM races) f USING (Driver, year, gp)""", _RESIDUALS))
def join_recent_form(spark, sf_dir):
    laps = _race_residuals(spark, sf_dir)
    # Written, so that its size is known and the laps meet it where they are.
    form = written_table(aggregates.recent_form(aggregates.race_residuals(laps)).drop("mean_residual"), "form")
    return laps.join(form, ["Driver", "year", "gp"], "left").select(
        *KEYS, F.round("avg_residual_last_3_races", 9).alias("avg_residual_last_3_races"))


@register("window_gp_order", laps_sql("""
SELECT year, gp, dense_rank() OVER (PARTITION BY year ORDER BY gp) AS gp_order FROM (SELECT DISTINCT year, gp FROM laps) d"""))
def window_gp_order(spark, sf_dir):
    return aggregates.gp_order(data.laps(spark, sf_dir))


NEUTRAL_SQL = f"""coalesce(rn - max(CASE WHEN z = 1 THEN rn END) OVER ({DRIVER} ORDER BY LapNumber), rn + 99)"""


@register("window_laps_since_neutralization", laps_sql(f"""
SELECT {KEY}, {NEUTRAL_SQL} AS laps_since_neutralization FROM (
  SELECT *, CAST(is_sc = 1 OR is_vsc = 1 AS INTEGER) AS z, row_number() OVER g AS rn FROM laps {LAP_WINDOW}) l"""))
def window_laps_since_neutralization(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, S.is_neutralized().alias("is_neutralized"))
    return history.laps_since_neutralization(laps).drop("is_neutralized")


_STATE = """
known AS (
  SELECT *, CASE WHEN NOT virt THEN change END AS sc, CASE WHEN virt THEN change END AS vsc FROM (
    SELECT *, contains(upper(Message), 'VIRTUAL') AS virt,
      CAST(contains(upper(Message), 'YELLOW') AND NOT contains(upper(Message), 'CLEAR') AS INTEGER) AS yellow,
      CASE WHEN Category = 'SafetyCar' THEN CASE WHEN coalesce(Status, '') = 'DEPLOYED' OR contains(upper(Message), 'DEPLOYED') THEN 1
        WHEN coalesce(Status, '') = 'ENDING' OR contains(upper(Message), 'IN THIS LAP') THEN 0 END END AS change
    FROM (SELECT * REPLACE (coalesce(Message, '') AS Message) FROM messages WHERE Lap IS NOT NULL) m) x),
state AS (
  SELECT *, CAST(coalesce(last_value(sc IGNORE NULLS) OVER w, 0) AS INTEGER) AS s, CAST(coalesce(last_value(vsc IGNORE NULLS) OVER w, 0) AS INTEGER) AS v
  FROM known WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flags AS (SELECT session, Lap, max(s) AS is_sc, max(v) AS is_vsc, max(yellow) AS is_yellow,
  arg_max(s, (ts, seq)) AS s_after, arg_max(v, (ts, seq)) AS v_after FROM state GROUP BY session, Lap)"""


@register("window_race_control_flags", messages_sql("SELECT session, Lap, is_sc, is_vsc, is_yellow FROM flags", _STATE))
def window_race_control_flags(spark, sf_dir):
    return joins.lap_flags(data.race_control(spark, sf_dir), keys=["session"], order=["ts", "seq"])


@register("window_race_control_flags_split", messages_sql("SELECT session, Lap, is_sc, is_vsc, is_yellow FROM flags", _STATE))
def window_race_control_flags_split(spark, sf_dir):
    messages = data.race_control(spark, sf_dir)
    return joins.lap_flags(messages, keys=["session"], order=["ts", "seq"], rows=SPLIT_ROWS)


@register("window_race_control_carry", messages_sql("""
SELECT l.session, CAST(l.lap AS INTEGER) AS Lap, CASE WHEN f.Lap = l.lap THEN is_sc ELSE s_after END AS is_sc,
  CASE WHEN f.Lap = l.lap THEN is_vsc ELSE v_after END AS is_vsc, CASE WHEN f.Lap = l.lap THEN is_yellow ELSE 0 END AS is_yellow
FROM (SELECT session, unnest(range(a, b + 1)) AS lap FROM (SELECT session, min(Lap) AS a, max(Lap) AS b FROM flags GROUP BY session) r) l
ASOF JOIN flags f ON l.session = f.session AND l.lap >= f.Lap""", _STATE))
def window_race_control_carry(spark, sf_dir):
    return joins.lap_flags(data.race_control(spark, sf_dir), keys=["session"], order=["ts", "seq"], carry_forward=True)


@register("window_current_history", laps_sql(f"""
SELECT {KEY}, coalesce(avg(LapTime) OVER (g ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 80) AS lap_time_mean_3,
  coalesce(lag(LapTime) OVER g - lag(LapTime, 2) OVER g, 0) AS lap_time_delta, TyreLife / 50 AS tyre_ratio FROM laps {LAP_WINDOW}"""))
def window_current_history(spark, sf_dir):
    return history.current_history(data.laps(spark, sf_dir).select(*KEYS, "LapTime", "TyreLife")).drop("LapTime", "TyreLife")


@register("window_running_total", base_sql(f"""
SELECT {KEY}, sum(LapTime + 20 * pit) OVER ({DRIVER} ORDER BY LapNumber ROWS UNBOUNDED PRECEDING) AS total_time
FROM (SELECT *, CAST(TyreLife = 8 AS INTEGER) AS pit FROM base) b"""))
def window_running_total(spark, sf_dir):
    laps = base_laps(spark, sf_dir).select(*KEYS, "LapTime", (F.col("TyreLife") == 8).cast("int").alias("pit"))
    return history.running_race_time(laps).select(*KEYS, "total_time")

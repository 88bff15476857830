"""Aggregates, profiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.filters import base_laps
from lapforge.catalog.registry import KEY, SPLIT_ROWS, base_sql, kept_sql, laps_sql, register, samples_sql
from lapforge.operators import aggregates, encoding, splits
from lapforge.plans import features, reports, training
from lapforge.session import written_table
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]
LAP = ["session", "driver", "lap"]


def rounded(df, digits=6, keep=()):
    """Round the irrational columns; both engines sum in their own order."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in keep})


def _sample_sql(drs: str, more: str = "", having: str = "") -> str:
    return samples_sql(f"""
SELECT session, driver, lap, avg(Speed) AS speed_mean, max(Speed) AS speed_max, round(stddev_samp(Speed), 6) AS speed_std,
  avg(Throttle) AS throttle_mean, round(stddev_samp(Throttle), 6) AS throttle_std,
  avg(CASE WHEN Brake > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS brake_ratio, avg(RPM) AS rpm_mean, avg(nGear) AS gear_mean,
  avg(CASE WHEN {drs} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS drs_ratio{more}
FROM samples GROUP BY session, driver, lap {having}""")


def _std_rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("speed_std", "throttle_std")})


@register("agg_lap_telemetry", _sample_sql("DRS >= 10", having="HAVING count(*) >= 10"))
def agg_lap_telemetry(spark, sf_dir):
    return _std_rounded(aggregates.lap_telemetry(data.telemetry_samples(spark, sf_dir), LAP))


@register("agg_lap_telemetry_simple", _sample_sql("DRS > 0"))
def agg_lap_telemetry_simple(spark, sf_dir):
    return _std_rounded(aggregates.lap_telemetry_simple(data.telemetry_samples(spark, sf_dir), LAP))


@register("agg_live_features", samples_sql("""
SELECT session, driver, avg(Speed) AS speed_mean, max(Speed) AS speed_max, round(stddev_samp(Speed), 6) AS speed_std,
  avg(Throttle) AS throttle_mean, round(stddev_samp(Throttle), 6) AS throttle_std,
  avg(CASE WHEN Brake > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS brake_ratio, avg(RPM) AS rpm_mean, avg(nGear) AS gear_mean,
  avg(CASE WHEN DRS > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS drs_ratio, avg(Brake) AS brake_mean,
  avg(LapTime) AS lap_time_mean_3, avg(change) AS lap_time_delta
FROM (SELECT *, LapTime - lag(LapTime) OVER (PARTITION BY session, driver ORDER BY ts, event_id) AS change FROM samples) s
GROUP BY session, driver"""))
def agg_live_features(spark, sf_dir):
    samples = data.telemetry_samples(spark, sf_dir)
    return _std_rounded(aggregates.live_features(samples, ["session", "driver"], order=["ts", "event_id"]))


@register("agg_live_speed", samples_sql("""
SELECT session, driver, avg(Speed) AS speed_mean, avg(Brake) AS brake_mean, avg(Throttle) AS throttle_mean,
  avg(Speed) AS lap_time_mean_3, arg_max(Speed, (ts, event_id)) - arg_min(Speed, (ts, event_id)) AS lap_time_delta
FROM samples GROUP BY session, driver"""))
def agg_live_speed(spark, sf_dir):
    return aggregates.live_speed(data.telemetry_samples(spark, sf_dir), ["session", "driver"], order=["ts", "event_id"])


@register("agg_target_encoding", base_sql("""
SELECT Driver, (count(*) * avg(LapTime) + 20 * any_value(gm)) / (count(*) + 20) AS enc, any_value(gm) AS global_mean
FROM base, (SELECT avg(LapTime) AS gm FROM base) g GROUP BY Driver
UNION ALL SELECT NULL, avg(LapTime), avg(LapTime) FROM base"""))
def agg_target_encoding(spark, sf_dir):
    return encoding.fit_target_encoding(base_laps(spark, sf_dir), "LapTime", "Driver")


# --- predictions: the driver's mean of the session stands in for a model ------------------------------------------------
_SCORED = """
scored AS (
  SELECT *, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS y,
    TyreLife / 8 - brake_ratio AS pred, LapNumber / max(LapNumber) OVER (PARTITION BY year, gp, session_code) AS LapNumber_pct FROM kept)"""


def scored_laps(spark, sf_dir):
    kept = features.surviving_laps(base_laps(spark, sf_dir))
    # Written, so that its size is known and the laps meet it where they are.
    longest = written_table(kept.groupBy(*K.SESSION).agg(F.max("LapNumber").alias("_laps")), "race-lengths")
    scored = kept.join(longest, K.SESSION).select(
        *KEYS, "Driver", F.col("LapTimeResidual").alias("y"), (F.col("TyreLife") / 8 - F.col("brake_ratio")).alias("pred"),
        (F.col("LapNumber") / F.col("_laps")).alias("LapNumber_pct"))
    # Every report reads it several times.
    return written_table(scored, "scored")


_METRICS = """round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
  round(1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(y), 0), 6) AS r2, count(y) AS n"""


@register("agg_error_metrics", kept_sql(f"SELECT {_METRICS} FROM scored", _SCORED))
def agg_error_metrics(spark, sf_dir):
    return rounded(aggregates.error_metrics(scored_laps(spark, sf_dir)))


@register("agg_error_metrics_by_session", kept_sql(f"SELECT year, session_code, {_METRICS} FROM scored GROUP BY year, session_code", _SCORED))
def agg_error_metrics_by_session(spark, sf_dir):
    return rounded(aggregates.error_metrics(scored_laps(spark, sf_dir), ["year", "session_code"]))


@register("agg_trivial_baseline", kept_sql("""
SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(std, 6) AS baseline_trivial_rmse, round(1 - rmse / nullif(std, 0), 6) AS improvement_over_trivial
FROM (SELECT sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae, stddev_samp(y) AS std FROM scored) s""", _SCORED))
def agg_trivial_baseline(spark, sf_dir):
    return rounded(aggregates.trivial_baseline(scored_laps(spark, sf_dir)))


_FOLDS = _SCORED + """,
folds AS (SELECT dense_rank() OVER (ORDER BY gp) AS fold, gp AS test_gp, sqrt(avg((y - pred) * (y - pred))) AS rmse,
  avg(abs(y - pred)) AS mae, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(y), 0) AS r2, count(*) AS test_rows
  FROM scored GROUP BY gp)"""


def _folds(spark, sf_dir):
    metrics = aggregates.error_metrics(scored_laps(spark, sf_dir), ["gp"])
    return splits.leave_one_group_out(metrics, "gp").withColumnRenamed("gp", "test_gp")


@register("agg_fold_summary", kept_sql("""
SELECT round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std,
  round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std FROM folds""", _FOLDS))
def agg_fold_summary(spark, sf_dir):
    return rounded(aggregates.fold_summary(_folds(spark, sf_dir)))


@register("agg_best_fold", kept_sql("""
SELECT test_gp AS best_group, round(rmse, 6) AS best_rmse FROM folds ORDER BY rmse, fold LIMIT 1""", _FOLDS))
def agg_best_fold(spark, sf_dir):
    return rounded(aggregates.best_fold(_folds(spark, sf_dir)))


@register("agg_fold_rows", kept_sql("""
SELECT CAST(fold AS INTEGER) AS fold, CAST((SELECT sum(test_rows) FROM folds) - test_rows AS BIGINT) AS train_rows, test_rows FROM folds""", _FOLDS))
def agg_fold_rows(spark, sf_dir):
    return aggregates.fold_rows(splits.leave_one_group_out(scored_laps(spark, sf_dir), "gp"))


@register("agg_error_by_gp", kept_sql("""
SELECT gp, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae, count(*) AS n FROM scored GROUP BY gp""", _SCORED))
def agg_error_by_gp(spark, sf_dir):
    return rounded(reports.diagnose(scored_laps(spark, sf_dir))["by_gp"])


def _driver_sql(order: str) -> str:
    return kept_sql(f"""
SELECT Driver, round(mae, 6) AS mae, n FROM (SELECT Driver, avg(abs(y - pred)) AS mae, count(*) AS n FROM scored GROUP BY Driver) d
ORDER BY {order} LIMIT 5""", _SCORED)


@register("agg_error_by_driver_hardest", _driver_sql("d.mae DESC, Driver"))
def agg_error_by_driver_hardest(spark, sf_dir):
    return rounded(reports.diagnose(scored_laps(spark, sf_dir))["hardest_drivers"])


@register("agg_error_by_driver_easiest", _driver_sql("d.mae, Driver DESC"))
def agg_error_by_driver_easiest(spark, sf_dir):
    return rounded(reports.diagnose(scored_laps(spark, sf_dir))["easiest_drivers"])


@register("agg_error_by_phase", kept_sql("""
SELECT race_phase, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, count(*) AS n FROM (
  SELECT *, CASE WHEN LapNumber_pct <= 0.2::DOUBLE THEN 'Início (0-20%)' WHEN LapNumber_pct <= 0.4::DOUBLE THEN '20-40%'
    WHEN LapNumber_pct <= 0.6::DOUBLE THEN '40-60%' WHEN LapNumber_pct <= 0.8::DOUBLE THEN '60-80%' ELSE 'Fim (80-100%)' END AS race_phase FROM scored) p
GROUP BY race_phase""", _SCORED))
def agg_error_by_phase(spark, sf_dir):
    return rounded(reports.diagnose(scored_laps(spark, sf_dir))["by_phase"])


# --- profile -----------------------------------------------------------------------------------------------------------
@register("agg_row_counts", laps_sql("""
SELECT year, session_code, count(*) AS n, CAST(grouping(year, session_code) AS BIGINT) AS level FROM laps
GROUP BY GROUPING SETS ((year), (year, session_code))"""))
def agg_row_counts(spark, sf_dir):
    return aggregates.row_counts(data.laps(spark, sf_dir))


PROFILED = ["LapTime", "Compound", "Stint", "Deleted", "PitInTime", "PitOutTime", "speed_mean", "AirTemp", "is_sc"]


@register("agg_coverage", laps_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows, 100 * count({c}) / count(*) AS pct FROM laps" for c in PROFILED)))
def agg_coverage(spark, sf_dir):
    return aggregates.coverage(data.laps(spark, sf_dir), [*PROFILED, "gap_to_pole_ms"])


_DESCRIBE = laps_sql("""
SELECT count(LapTime) AS n, round(avg(LapTime), 6) AS mean, round(stddev_samp(LapTime), 6) AS std, min(LapTime) AS min, max(LapTime) AS max,
  round(quantile_cont(LapTime, 0.01), 6) AS p01, quantile_cont(LapTime, 0.5) AS p50, round(quantile_cont(LapTime, 0.99), 6) AS p99 FROM laps""")


@register("agg_describe_split", _DESCRIBE)
def agg_describe_split(spark, sf_dir):
    """The same figures with the values of the one group spread over tasks."""
    return rounded(aggregates.describe(data.laps(spark, sf_dir), "LapTime", rows=SPLIT_ROWS), keep=("min", "max", "p50"))


@register("agg_describe", _DESCRIBE)
def agg_describe(spark, sf_dir):
    return rounded(aggregates.describe(data.laps(spark, sf_dir), "LapTime"), keep=("min", "max", "p50"))


@register("agg_group_count", laps_sql("SELECT count(DISTINCT gp) AS n_groups FROM laps"))
def agg_group_count(spark, sf_dir):
    return aggregates.group_count(data.laps(spark, sf_dir))


@register("agg_distinct_years", laps_sql("SELECT DISTINCT year FROM laps"))
def agg_distinct_years(spark, sf_dir):
    return aggregates.distinct_years(data.laps(spark, sf_dir))


@register("agg_race_totals", base_sql("""
SELECT year, gp, session_code, DriverNumber, sum(LapTime) + 20 * sum(pit) AS total_time, (sum(LapTime) + 20 * sum(pit)) / count(*) AS mean_lap,
  CAST(sum(pit) AS BIGINT) AS pit_stops FROM (SELECT *, CAST(TyreLife = 8 AS INTEGER) AS pit FROM base) b GROUP BY ALL"""))
def agg_race_totals(spark, sf_dir):
    laps = base_laps(spark, sf_dir).withColumn("pit", (F.col("TyreLife") == 8).cast("int"))
    return aggregates.race_totals(laps, K.LAP_GROUP)


# --- importance: the spread a column explains, as a stand-in for a model's numbers ------------------------------------------
IMPORTANT = ["TyreLife", "Position", "speed_mean", "speed_max", "throttle_mean", "throttle_std", "brake_ratio", "rpm_mean",
             "gear_mean", "drs_ratio", "AirTemp", "TrackTemp", "Humidity"]
_IMPORTANCE = """
importance AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(stddev_pop({c}), 6) AS importance FROM base" for c in IMPORTANT) + ")"


def _importance(spark, sf_dir):
    spreads = base_laps(spark, sf_dir).agg(*[F.round(F.stddev_pop(c), 6).alias(c) for c in IMPORTANT])
    return spreads.unpivot([], IMPORTANT, "feature", "importance")


@register("agg_importance_share", base_sql("""
SELECT round(100 * sum(CASE WHEN rn <= 3 THEN importance END), 3) AS top3_pct, round(100 * sum(CASE WHEN rn <= 10 THEN importance END), 3) AS top10_pct,
  100 * sum(CASE WHEN rn <= 3 THEN importance END) > 65 AS concentrated
FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rn FROM importance) r""", _IMPORTANCE))
def agg_importance_share(spark, sf_dir):
    return rounded(aggregates.importance_share(_importance(spark, sf_dir)), 3)


@register("report_top_features", base_sql("SELECT feature, importance FROM importance ORDER BY importance DESC, feature LIMIT 5", _IMPORTANCE))
def report_top_features(spark, sf_dir):
    return _importance(spark, sf_dir).orderBy(F.col("importance").desc(), "feature").limit(5)


@register("report_fastest_laps", base_sql(f"""
SELECT {KEY}, LapTime FROM (SELECT *, row_number() OVER (PARTITION BY year, gp, session_code ORDER BY LapTime, DriverNumber, LapNumber) AS rn FROM base) r
WHERE rn <= 3"""))
def report_fastest_laps(spark, sf_dir):
    laps = base_laps(spark, sf_dir).select(*K.LAP_GROUP, "LapNumber", "LapTime")
    order = [F.col("LapTime"), F.col("DriverNumber"), F.col("LapNumber")]
    return splits.top_per_group(laps, K.SESSION, order, 3)


# --- local against global -------------------------------------------------------------------------------------------------
_COMPARED = _SCORED + """,
fit AS (SELECT gp, regr_slope(y, LapNumber) AS a, regr_intercept(y, LapNumber) AS b FROM scored GROUP BY gp),
global_results AS (SELECT gp, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae,
  1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(y), 0) AS r2 FROM scored GROUP BY gp),
local_results AS (SELECT gp, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2, count(*) AS n
  FROM (SELECT scored.*, a * LapNumber + b AS p FROM scored JOIN fit USING (gp)) s GROUP BY gp)"""


@register("report_model_comparison", kept_sql("""
SELECT gp, round(g.rmse, 6) AS rmse_global, round(g.mae, 6) AS mae_global, round(g.r2, 6) AS r2_global, round(l.rmse, 6) AS rmse_local_optuna,
  round(l.mae, 6) AS mae_local_optuna, round(l.r2, 6) AS r2_local_optuna, n AS rows,
  CASE WHEN l.rmse < g.rmse THEN 'local_optuna' ELSE 'global_optuna' END AS rmse_winner,
  CASE WHEN l.mae < g.mae THEN 'local_optuna' ELSE 'global_optuna' END AS mae_winner,
  CASE WHEN l.r2 > g.r2 THEN 'local_optuna' ELSE 'global_optuna' END AS r2_winner,
  round(g.rmse - l.rmse, 6) AS rmse_gain, round(g.mae - l.mae, 6) AS mae_gain, round(l.r2 - g.r2, 6) AS r2_gain
FROM global_results g JOIN local_results l USING (gp)""", _COMPARED))
def report_model_comparison(spark, sf_dir):
    scored = scored_laps(spark, sf_dir)
    lines = training.local_fits(scored, y="y").select("gp", "slope", "intercept")
    local = scored.join(lines, "gp").withColumn("pred_local", F.col("slope") * F.col("LapNumber") + F.col("intercept"))
    by_track = aggregates.error_metrics(local, ["gp"], prediction="pred_local").select(
        "gp", F.col("rmse").alias("rmse_local_optuna"), F.col("mae").alias("mae_local_optuna"),
        F.col("r2").alias("r2_local_optuna"), F.col("n").alias("rows"))
    overall = aggregates.error_metrics(scored, ["gp"]).withColumnRenamed("gp", "test_gp")
    return rounded(reports.compare_models(overall, by_track))


@register("model_local_lines", kept_sql("""
SELECT gp, round(regr_slope(y, LapNumber), 6) AS slope, round(regr_intercept(y, LapNumber), 6) AS intercept,
  round(regr_r2(y, LapNumber), 6) AS fit_r2, CAST(regr_count(y, LapNumber) AS BIGINT) AS n FROM scored GROUP BY gp""", _SCORED))
def model_local_lines(spark, sf_dir):
    return rounded(training.local_fits(scored_laps(spark, sf_dir), y="y"))


@register("model_local_ridge", kept_sql("""
SELECT gp, CAST(regr_count(y, LapNumber) AS BIGINT) AS n, round(regr_intercept(y, LapNumber), 5) AS intercept, round(regr_slope(y, LapNumber), 5) AS slope
FROM scored GROUP BY gp""", _SCORED))
def model_local_ridge(spark, sf_dir):
    fits = training.fit_local_linear(scored_laps(spark, sf_dir), ["LapNumber"], target="y")
    return fits.select("gp", "n", F.round(F.col("coefficients")[0], 5).alias("intercept"), F.round(F.col("coefficients")[1], 5).alias("slope"))

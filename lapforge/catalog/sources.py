"""Sources, sinks and the ingest plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge import schemas
from lapforge.catalog.registry import KEY, laps_sql, messages_sql, quali_sql, register
from lapforge.functions import scalars as S
from lapforge.operators import aggregates
from lapforge.plans import ingest, training
from lapforge.session import fresh_path, written_table
from lapforge.sources import batches, tables
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]


@register("source_csv_round_trip", laps_sql("""
SELECT year, gp, session_code, Driver, DriverNumber, Team, LapNumber, CAST(Stint AS DOUBLE) AS Stint, Compound, TyreLife, LapTime,
  Deleted, speed_mean, brake_ratio FROM laps"""))
def source_csv_round_trip(spark, sf_dir):
    columns = ["year", "gp", "session_code", "Driver", "DriverNumber", "Team", "LapNumber", "Stint", "Compound", "TyreLife",
               "LapTime", "Deleted", "speed_mean", "brake_ratio"]
    laps = data.laps(spark, sf_dir).select(*columns).withColumn("Stint", F.col("Stint").cast("double"))
    path = fresh_path(spark, "laps-csv")
    tables.write_csv(laps, path)
    kinds = dict(laps.dtypes)
    return tables.read_csv(spark, path, ", ".join(f"{c} {kinds[c]}" for c in columns))


@register("source_parquet_partitioned", laps_sql(f"SELECT {KEY}, LapTime FROM laps WHERE session_code = 'R'"))
def source_parquet_partitioned(spark, sf_dir):
    path = fresh_path(spark, "laps-parquet")
    tables.write_parquet(data.laps(spark, sf_dir).select(*KEYS, "LapTime"), path)
    return tables.read_parquet(spark, path).where(F.col("session_code") == "R").select(*KEYS, "LapTime")


@register("source_json_outcomes", laps_sql("""
SELECT year || '|' || gp || '|' || session_code AS key, 'completed' AS status, count(*) AS n_rows FROM laps GROUP BY 1"""))
def source_json_outcomes(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    counts = laps.groupBy(S.session_key().alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    path = fresh_path(spark, "outcomes-json")
    tables.write_json(counts.withColumn("status", F.lit("completed")), path)
    return spark.read.schema("key string, status string, n_rows bigint").json(path).select("key", "status", "n_rows")


@register("source_checkpoint_state", laps_sql("""
SELECT CASE WHEN session_code = 'T' THEN 'failed' ELSE 'completed' END AS status, year || '|' || gp || '|' || session_code AS key
FROM laps GROUP BY year, gp, session_code"""))
def source_checkpoint_state(spark, sf_dir):
    """State files in the completed/failed layout, one per event so that no list grows with the table."""
    keyed = data.laps(spark, sf_dir).select("gp", "session_code", S.session_key().alias("key")).distinct()
    failed = F.col("session_code") == "T"
    states = keyed.groupBy("gp").agg(
        F.collect_list(F.when(~failed, F.col("key"))).alias("completed"),
        F.collect_list(F.when(failed, F.col("key"))).alias("failed"))
    path = fresh_path(spark, "checkpoint-json")
    states.select("completed", "failed").write.mode("overwrite").json(path)
    return tables.read_checkpoint(spark, path, multi_line=False)




_CANDIDATES = ["LapNumber", "Stint", "TyreLife", "Position", "LapTime", "PitInTime", "speed_mean", "Rainfall", "Driver", "Team"]
_ENCODED = ["Driver", "Team"]


@register("source_feature_list", laps_sql("""
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS position, feature, non_null FROM counted WHERE non_null >= 0.9 * n""", "counted AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}{'_te' if c in _ENCODED else ''}' AS feature, count({c}) AS non_null, count(*) AS n FROM laps" for i, c in enumerate(_CANDIDATES)) + ")"))
def source_feature_list(spark, sf_dir):
    """The features that nine laps in ten have, in order, written as JSON and as text, read back, with their coverage."""
    laps, kept = data.laps(spark, sf_dir), _CANDIDATES
    counts = written_table(aggregates.coverage(laps, kept), "coverage")
    found = training.covered(counts, kept, 90.0)
    numeric, encoded = [c for c in found if c not in _ENCODED], [c for c in found if c in _ENCODED]
    as_json, as_text = fresh_path(spark, "features-json"), fresh_path(spark, "features-text")
    tables.write_feature_list(spark, as_json, numeric, encoded)
    tables.write_feature_text(spark, as_text, [*numeric, *(f"{c}_te" for c in encoded)])
    listed = tables.read_feature_list(spark, as_json).join(tables.read_feature_text(spark, as_text), "feature")
    name = F.regexp_replace("feature", "_te$", "").alias("column_name")
    return listed.select("position", "feature", name).join(counts, "column_name").select("position", "feature", "non_null")


_SCHEDULE = """
raw AS (SELECT DISTINCT year, gp AS EventName,
    CASE WHEN round % 7 = 3 THEN 'n/a' ELSE CAST(round AS VARCHAR) END AS RoundNumber FROM laps),
schedule AS (SELECT year, EventName, CAST(TRY_CAST(RoundNumber AS DOUBLE) AS INTEGER) AS RoundNumber FROM raw),
plan AS (SELECT year || '|' || EventName || '|' || session_code AS key, year, EventName AS gp, RoundNumber AS round, session_code
  FROM schedule CROSS JOIN (SELECT unnest(['R', 'Q']) AS session_code) c WHERE RoundNumber <> 0 AND year IN (1999, 2000, 2001)),
log AS (SELECT year || '|' || gp || '|' || session_code AS key,
    CASE WHEN count(*) > 110 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n_rows FROM laps GROUP BY 1)"""
SEASONS = [1999, 2000, 2001]


def _raw_schedule(spark, sf_dir):
    number = F.when(F.col("round") % 7 == 3, "n/a").otherwise(F.col("round").cast("string"))
    return data.laps(spark, sf_dir).select("year", F.col("gp").alias("EventName"), number.alias("RoundNumber")).distinct()


def _plan(spark, sf_dir):
    return ingest.session_plan(spark, ingest.load_schedule(_raw_schedule(spark, sf_dir)), years=SEASONS)


def _log(spark, sf_dir):
    counts = data.laps(spark, sf_dir).groupBy(S.session_key().alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("key", F.when(F.col("n_rows") > 110, "completed").otherwise("failed").alias("status"), "n_rows")


@register("ingest_schedule", laps_sql("SELECT * FROM schedule", _SCHEDULE))
def ingest_schedule(spark, sf_dir):
    return ingest.load_schedule(_raw_schedule(spark, sf_dir))


@register("ingest_plan", laps_sql("SELECT key, year, gp, round, session_code FROM plan", _SCHEDULE))
def ingest_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("key", "year", "gp", "round", "session_code")


@register("ingest_resume", laps_sql("""
SELECT key, year, gp, round, session_code FROM plan WHERE key NOT IN (SELECT key FROM log WHERE status = 'completed')""", _SCHEDULE))
def ingest_resume(spark, sf_dir):
    pending = ingest.pending(_plan(spark, sf_dir), _log(spark, sf_dir))
    return pending.select("key", "year", "gp", "round", "session_code")


@register("ingest_exactly_once", laps_sql("""
SELECT year || '|' || gp || '|' || session_code AS key, CASE WHEN gp = 'NATION_0' THEN 'failed' ELSE 'completed' END AS status,
  CAST(CASE WHEN gp = 'NATION_0' THEN 0 ELSE count(*) END AS BIGINT) AS n_rows, CAST(CASE WHEN gp = 'NATION_0' THEN 0 ELSE count(*) END AS BIGINT) AS stored
FROM laps GROUP BY gp, 1"""))
def ingest_exactly_once(spark, sf_dir):
    """A run that crashes between data and manifest and is run again, and a batch that is run twice: every lap is there once."""
    path, laps = fresh_path(spark, "committed"), data.laps(spark, sf_dir)
    sessions = laps.select("year", "gp", "session_code").distinct().withColumn("key", S.session_key())

    def load(todo):
        return laps.where(F.col("gp") != "NATION_0").join(todo.select(*K.SESSION), K.SESSION, "left_semi")

    def crash():
        raise InterruptedError("between data and manifest")

    for code, before_commit in (("R", None), ("Q", crash), ("Q", None), ("R", None), ("T", None)):
        try:
            ingest.run_batch(spark, path, code, sessions.where(F.col("session_code") == code), load, before_commit)
        except InterruptedError:
            pass
    stored = batches.committed_rows(spark, path, laps.schema).groupBy(S.session_key().alias("key")).agg(F.count(F.lit(1)).alias("stored"))
    return batches.committed_outcomes(spark, path).join(stored, "key", "left").select("key", "status", "n_rows", F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"))


@register("ingest_append", laps_sql(f"""
SELECT {KEY}, LapTime, CASE WHEN year >= 1999 THEN AirTemp END AS AirTemp FROM laps"""))
def ingest_append(spark, sf_dir):
    """An older batch without weather, then a newer one with it, appended to one table."""
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime", "AirTemp")
    path = fresh_path(spark, "accumulated")
    tables.append_batch(laps.where(F.col("year") < 1999).drop("AirTemp"), path)
    tables.append_batch(laps.where(F.col("year") >= 1999), path)
    return tables.read_accumulated(spark, path).select(*KEYS, "LapTime", "AirTemp")


@register("ingest_outcomes", laps_sql("""
SELECT plan.key, CASE WHEN coalesce(n_rows, 0) > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(n_rows, 0) AS n_rows
FROM plan LEFT JOIN (SELECT key, n_rows FROM log WHERE key LIKE '%R') l USING (key)""", _SCHEDULE))
def ingest_outcomes(spark, sf_dir):
    races = data.laps(spark, sf_dir).where(F.col("session_code") == "R")
    return ingest.outcome(_plan(spark, sf_dir), races)


@register("ingest_latest_outcomes", messages_sql("""
SELECT session AS key, arg_max(coalesce(Status, 'none'), seq) AS status, max(seq) AS seq FROM messages GROUP BY session"""))
def ingest_latest_outcomes(spark, sf_dir):
    log = data.race_control(spark, sf_dir).select(
        F.col("session").alias("key"), F.coalesce("Status", F.lit("none")).alias("status"), "seq")
    return ingest.latest_outcomes(log).select("key", "status", "seq")


@register("source_head", laps_sql(f"SELECT {KEY}, LapTime FROM laps ORDER BY {KEY} LIMIT 5"))
def source_head(spark, sf_dir):
    return aggregates.head(data.laps(spark, sf_dir).select(*KEYS, "LapTime"), KEYS)


@register("source_shape", laps_sql("SELECT count(*) AS n_rows, CAST(36 AS INTEGER) AS n_columns FROM laps"))
def source_shape(spark, sf_dir):
    return aggregates.table_shape(data.laps(spark, sf_dir))


@register("source_run_log", laps_sql("""
SELECT 'walk-forward' AS run_id, kind, key, value FROM (
  SELECT 'metric' AS kind, unnest(['n_rows', 'n_groups']) AS key, unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT gp) AS VARCHAR)]) AS value FROM laps
  UNION ALL SELECT 'param', unnest(['first_year', 'last_year']), unnest([CAST(min(year) AS VARCHAR), CAST(max(year) AS VARCHAR)]) FROM laps) l"""))
def source_run_log(spark, sf_dir):
    laps, path = data.laps(spark, sf_dir), fresh_path(spark, "runs")
    metrics = laps.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("gp").alias("n_groups"))
    params = laps.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    tables.append_run_log(tables.log_values(metrics, "walk-forward", "metric"), path)
    tables.append_run_log(tables.log_values(params, "walk-forward", "param"), path)
    return spark.read.schema(schemas.RUNS).parquet(path)


@register("union_rows", laps_sql(f"""
SELECT {KEY}, LapTime, CAST(NULL AS DOUBLE) AS AirTemp FROM laps WHERE session_code = 'R' UNION ALL
SELECT {KEY}, CAST(NULL AS DOUBLE), AirTemp FROM laps WHERE session_code = 'Q'"""))
def union_rows(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    return tables.union_columns(
        laps.where(F.col("session_code") == "R").select(*KEYS, "LapTime"),
        laps.where(F.col("session_code") == "Q").select(*KEYS, "AirTemp"))

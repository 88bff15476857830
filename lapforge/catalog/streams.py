"""Structured Streaming queries, drained with an available-now trigger so that they can be checked as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge import schemas
from lapforge.catalog.registry import KEY, LAP_WINDOW, laps_sql, register, samples_sql
from lapforge.catalog.windows import HISTORY_SQL
from lapforge.functions import scalars as S
from lapforge.operators import aggregates
from lapforge.operators.splits import latest_per_key
from lapforge.plans import stages
from lapforge.session import fresh_path, written_table
from lapforge.sources import testdata as data
from lapforge.streaming import history as stream_history
from lapforge.streaming import ingest as stream_ingest
from lapforge.streaming import keyed, live

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]
_LIVE = """avg(Speed) AS speed_mean, max(Speed) AS speed_max, round(stddev_samp(Speed), 6) AS speed_std,
  avg(Throttle) AS throttle_mean, round(stddev_samp(Throttle), 6) AS throttle_std,
  avg(CASE WHEN Brake > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS brake_ratio, avg(RPM) AS rpm_mean, avg(nGear) AS gear_mean,
  avg(CASE WHEN DRS > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS drs_ratio, avg(Brake) AS brake_mean,
  avg(LapTime) AS lap_time_mean_3, avg(change) AS lap_time_delta"""


def _live_sql(key: str) -> str:
    return f"""SELECT {key}, {_LIVE} FROM (
  SELECT *, LapTime - lag(LapTime) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS change
  FROM (SELECT *, date_trunc('day', ts) AS window_start FROM samples) d) s GROUP BY {key}"""


def _fed(rows, slot, slots: int, path: str, drain):
    """Append each slot's rows to the feed, with as many files as Spark gives, and drain the stream after each."""
    for i in range(slots):
        rows.where(slot == i).write.mode("append").parquet(path)
        out = drain()
    return out


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("speed_std", "throttle_std")})


def _shuffled(column: str, slots: int = 3):
    return F.pmod(F.xxhash64(column), F.lit(slots))


@register("stream_live_features", samples_sql(_live_sql("session, driver")))
def stream_live_features(spark, sf_dir):
    """Samples in any order: the watermark's delay is longer than the feed, so late ones still find their neighbours."""
    feed, out, state = (fresh_path(spark, n) for n in ("feed", "live-out", "live-state"))
    events, keys = data.table(spark, sf_dir, "events"), ["session", "driver"]

    def drain():
        samples = data.as_samples(live.event_stream(spark, feed))
        live.drain_panes(samples, keys, out, state, delay="1000 days", pane="1 day")

    _fed(events, _shuffled("event_id"), 3, feed, drain)
    return _rounded(live.features_of_panes(spark, out, keys))


_ARRIVALS = """
arrived AS (
  SELECT *, least(2, 3 * (epoch_us(ts) - a) // (b - a)) + CAST(event_id % 5 = 0 AS INTEGER) AS slot
  FROM samples, (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM samples) t),
marks AS (
  SELECT slot, max(max(epoch_us(ts))) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 2 * 86400000 AS watermark
  FROM arrived GROUP BY slot),
in_time AS (
  SELECT arrived.* FROM arrived JOIN marks USING (slot)
  WHERE watermark IS NULL OR epoch_us(date_trunc('hour', ts)) // 1000 + 3600000 > watermark)"""


@register("stream_windowed_features", samples_sql(
    _live_sql("session, window_start").replace("FROM samples", "FROM in_time"), _ARRIVALS))
def stream_windowed_features(spark, sf_dir):
    """Windows of a day from panes of an hour. One sample in five comes a third of the feed late: within the watermark's two
    days it counts, beyond them it is dropped."""
    feed, out, state = (fresh_path(spark, n) for n in ("feed", "live-out", "live-state"))
    events = data.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    slot = F.least(F.lit(2), F.expr("3 * (unix_micros(cast(ts as timestamp)) - _a) div (_b - _a)")) + (F.col("event_id") % 5 == 0).cast("int")
    dealt = events.join(F.broadcast(span)).withColumn("_slot", slot).drop("_a", "_b")

    def drain():
        samples = data.as_samples(live.event_stream(spark, feed))
        live.drain_panes(samples, ["session"], out, state, delay="2 days", pane="1 hour")

    _fed(dealt, F.col("_slot"), 4, feed, drain)
    found = live.features_of_panes(spark, out, ["session"], window="day")
    return _rounded(found).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("stream_live_scores", samples_sql("""
SELECT session, driver, round(y0 + b1 * (x1 - m1) + b2 * (x2 - m2), 6) AS prediction
FROM (SELECT live.session, driver, speed_mean AS x1, enc AS x2 FROM live JOIN encoded USING (session)) l,
  (SELECT avg(y) AS y0, avg(x1) AS m1, avg(x2) AS m2,
     (covar_pop(y, x1) * var_pop(x2) - covar_pop(y, x2) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) * covar_pop(x1, x2)) AS b1,
     (covar_pop(y, x2) * var_pop(x1) - covar_pop(y, x1) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) * covar_pop(x1, x2)) AS b2
   FROM (SELECT lap_time_mean_3 AS y, speed_mean AS x1, enc AS x2 FROM live JOIN encoded USING (session) WHERE lap_time_mean_3 IS NOT NULL) t) f""",
    f"live AS ({_live_sql('session, driver')})", """
encoded AS (
  SELECT session, (sum(lap_time_mean_3) + 20 * gm) / (count(lap_time_mean_3) + 20) AS enc
  FROM live, (SELECT avg(lap_time_mean_3) AS gm FROM live) g GROUP BY session, gm)"""))
def stream_live_scores(spark, sf_dir):
    """A pipeline of target encoding and a linear model, fitted on the stored samples, saved, loaded, and applied to the stream."""
    feed, out, state, path = (fresh_path(spark, n) for n in ("feed", "score-out", "score-state", "score-model"))
    events, keys = data.table(spark, sf_dir, "events"), ["session", "driver"]
    stored = aggregates.live_features(data.telemetry_samples(spark, sf_dir), keys, order=["ts", "event_id"])
    pipeline = stages.encoded_regression(["speed_mean"], ["session"], target="lap_time_mean_3")
    pipeline.fit(written_table(stored.na.drop(subset=["lap_time_mean_3"]), "stored-features")).write().overwrite().save(path)
    model = stages.load_pipeline(spark, path)

    def drain():
        live.drain_scores(data.as_samples(live.event_stream(spark, feed)), keys, model, out, state)

    _fed(events, _shuffled("event_id"), 3, feed, drain)
    scored = latest_per_key(spark.read.parquet(out), keys, ["_batch"])
    return scored.select(*keys, F.round("prediction", 6).alias("prediction"))


def _history(spark, sf_dir, slot):
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime")
    feed, out, state = (fresh_path(spark, n) for n in ("lap-feed", "history-out", "history-state"))

    def drain():
        return stream_history.history_in_batches(spark.readStream.schema(laps.schema).parquet(feed), K.LAP_GROUP, out, state)

    return _fed(laps, slot, 3, feed, drain).withColumn("lap_time_std_5_prev", F.round("lap_time_std_5_prev", 6))


_LAP_HISTORY_SQL = laps_sql(f"SELECT {KEY}, LapTime, {HISTORY_SQL} FROM laps {LAP_WINDOW}")


@register("stream_lap_history", _LAP_HISTORY_SQL)
def stream_lap_history(spark, sf_dir):
    """Laps in order, several micro-batches."""
    return _history(spark, sf_dir, F.least(F.lit(2), F.floor(F.col("LapNumber") / 4)))


@register("stream_lap_history_batches", _LAP_HISTORY_SQL)
def stream_lap_history_batches(spark, sf_dir):
    """Laps out of order: late ones correct the history of the laps behind them."""
    return _history(spark, sf_dir, F.pmod(F.xxhash64(*KEYS), F.lit(3)))


@register("stream_lap_history_keyed", _LAP_HISTORY_SQL)
def stream_lap_history_keyed(spark, sf_dir):
    """Laps up to half a race late, put in order by keyed state and timers; the last slot ends with a record of a later time."""
    feed, out, state = (fresh_path(spark, n) for n in ("lap-feed", "keyed-out", "keyed-state"))
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime").withColumn("finished", F.timestamp_seconds(F.col("LapNumber") * 60))
    half = (laps.agg(F.max("LapNumber")).first()[0] + 1) // 2
    end = laps.limit(1).withColumns({
        "DriverNumber": F.lit(-1), "finished": F.lit("2100-01-01 00:00:00").cast("timestamp"), "_slot": F.lit(2).cast("bigint")})
    slot = F.expr(f"(LapNumber - 1) div {half}") + F.pmod(F.xxhash64(*KEYS), F.lit(2))

    def drain():
        stream = spark.readStream.schema(laps.schema).parquet(feed)
        keyed.drain_history(stream, K.LAP_GROUP, out, state, time="finished", delay=f"{half} minutes", forget_ms=1 << 50)

    _fed(laps.withColumn("_slot", slot).unionByName(end), F.col("_slot"), 3, feed, drain)
    found = spark.read.parquet(out).where("DriverNumber >= 0")
    return found.withColumns({"LapNumber": F.col("LapNumber").cast("int"), "lap_time_std_5_prev": F.round("lap_time_std_5_prev", 6)})


@register("stream_ingest", laps_sql("""
SELECT year || '|' || gp || '|' || session_code AS key, CASE WHEN gp = 'NATION_0' THEN 'failed' ELSE 'completed' END AS status,
  CAST(CASE WHEN gp = 'NATION_0' THEN 0 ELSE count(*) END AS BIGINT) AS n_rows FROM laps GROUP BY gp, 1"""))
def stream_ingest_sessions(spark, sf_dir):
    """New session files once, a run for each session code, then one that finds nothing new; one event's files never come."""
    source, target, log, state = (fresh_path(spark, f"ingest-{n}") for n in ("in", "laps", "log", "state"))
    laps = data.laps(spark, sf_dir)
    plan = laps.select("year", "gp", "session_code").distinct().select(S.session_key().alias("key"))
    for code in ("R", "Q", "T"):
        laps.where((F.col("session_code") == code) & (F.col("gp") != "NATION_0")).write.mode("append").parquet(source)
        stream_ingest.ingest_new_files(spark, source, laps.schema, target, log, state)
    stream_ingest.ingest_new_files(spark, source, laps.schema, target, log, state, plan)
    outcomes = spark.read.schema(schemas.OUTCOMES).parquet(log)
    return latest_per_key(outcomes, ["key"], ["seq"]).select("key", "status", "n_rows")

"""Row filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.registry import EXCLUDED, KEY, SPLIT_ROWS, TRACKS, base_sql, kept_sql, laps_sql, register, samples_sql
from lapforge.operators import aggregates, filters, segments, sketches
from lapforge.plans import features
from lapforge.session import fresh_path
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]


def base_laps(spark, sf_dir):
    return filters.basic_filter(data.laps(spark, sf_dir), excluded=EXCLUDED)


@register("filter_basic", base_sql(f"SELECT {KEY}, LapTime FROM base"))
def filter_basic(spark, sf_dir):
    return base_laps(spark, sf_dir).select(*KEYS, "LapTime")


@register("filter_session_split", base_sql(f"SELECT {KEY}, LapTime FROM base WHERE session_code = 'Q'"))
def filter_session_split(spark, sf_dir):
    return filters.session_is(base_laps(spark, sf_dir), "Q").select(*KEYS, "LapTime")


@register("filter_iqr", kept_sql(f"SELECT {KEY}, LapTime FROM kept"))
def filter_iqr(spark, sf_dir):
    return filters.iqr_filter(base_laps(spark, sf_dir)).select(*KEYS, "LapTime")


@register("filter_iqr_split", kept_sql(f"SELECT {KEY}, LapTime FROM kept"))
def filter_iqr_split(spark, sf_dir):
    """The same fences with every session's values spread over tasks."""
    return filters.iqr_filter(base_laps(spark, sf_dir), rows=SPLIT_ROWS).select(*KEYS, "LapTime")


#: SQL of the sketch: the bins of every session, and the middle of the bin in which a rank lies.
_BASE_OF_BINS = (1 + sketches.ERROR) / (1 - sketches.ERROR)
_SKETCH_SQL = f"""
bins AS (SELECT year, gp, session_code, CAST(ceil(ln(LapTime) / {math.log(_BASE_OF_BINS)!r}::DOUBLE) AS BIGINT) AS b, count(*) AS n FROM base GROUP BY ALL),
along AS (
  SELECT *, sum(n) OVER (PARTITION BY year, gp, session_code ORDER BY b) AS upto, sum(n) OVER (PARTITION BY year, gp, session_code) AS total FROM bins)"""


def _sketched_sql(**probs: float) -> str:
    picked = ", ".join(
        f"2 * pow({_BASE_OF_BINS!r}::DOUBLE, min(b) FILTER (WHERE upto > floor({p}::DOUBLE * (total - 1)))) / {_BASE_OF_BINS + 1!r}::DOUBLE AS {n}" for n, p in probs.items())
    return f"sketched AS (SELECT year, gp, session_code, {picked} FROM along GROUP BY ALL)"


def _stored_sketch(spark, laps):
    """The sessions' sketch from three batches stored one after the other, one of them twice."""
    path = fresh_path(spark, "sketches")
    for i in (0, 1, 1, 2):
        sketches.store(sketches.sketch(laps.where(F.col("LapNumber") % 3 == i), K.SESSION, "LapTime"), path, str(i))
    return sketches.merged(spark, path, K.SESSION)


@register("filter_iqr_sketched", base_sql(f"""
SELECT {KEY}, LapTime FROM base JOIN sketched USING (year, gp, session_code)
WHERE LapTime BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""", _SKETCH_SQL, _sketched_sql(q1=0.25, q3=0.75)))
def filter_iqr_sketched(spark, sf_dir):
    """Fences from sketches that were stored batch by batch; the rows are not read again for them."""
    laps = base_laps(spark, sf_dir)
    quartiles = sketches.sketched_quantiles(_stored_sketch(spark, laps), K.SESSION, filters.QUARTILES)
    return filters.iqr_filter(laps, quartiles=quartiles).select(*KEYS, "LapTime")


@register("agg_sketch_quantiles", base_sql(f"""
SELECT year, gp, session_code, round(p1, 6) AS p1, round(p50, 6) AS p50, round(p99, 6) AS p99,
  abs(p1 - e1) <= {sketches.ERROR}::DOUBLE * e1 AND abs(p50 - e50) <= {sketches.ERROR}::DOUBLE * e50 AND abs(p99 - e99) <= {sketches.ERROR}::DOUBLE * e99 AS in_bound
FROM sketched JOIN (
  SELECT year, gp, session_code, l[1 + CAST(floor(0.01::DOUBLE * (len(l) - 1)) AS BIGINT)] AS e1, l[1 + CAST(floor(0.5::DOUBLE * (len(l) - 1)) AS BIGINT)] AS e50,
    l[1 + CAST(floor(0.99::DOUBLE * (len(l) - 1)) AS BIGINT)] AS e99
  FROM (SELECT year, gp, session_code, list_sort(list(LapTime)) AS l FROM base GROUP BY ALL) s) e USING (year, gp, session_code)""",
    _SKETCH_SQL, _sketched_sql(p1=0.01, p50=0.5, p99=0.99)))
def agg_sketch_quantiles(spark, sf_dir):
    """Quantiles from stored sketches beside the exact values of their ranks: whether each is within the stated error."""
    laps, probs = base_laps(spark, sf_dir), {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    got = sketches.sketched_quantiles(_stored_sketch(spark, laps), K.SESSION, probs)
    counted = laps.groupBy(*K.SESSION).agg(F.count("LapTime").alias("_n"))
    ranked = segments.group_position(laps.select(*KEYS, "LapTime"), K.SESSION, ["LapTime"], "_at").withColumn("_at", F.col("_at") - 1).join(counted, K.SESSION)
    of_rank = ranked.groupBy(*K.SESSION).agg(*[
        F.max(F.when(F.col("_at") == F.floor(F.lit(p) * (F.col("_n") - 1)), F.col("LapTime"))).alias(f"_{n}") for n, p in probs.items()])
    near = [F.abs(F.col(n) - F.col(f"_{n}")) <= sketches.ERROR * F.col(f"_{n}") for n in probs]
    return got.join(of_rank, K.SESSION).select(*K.SESSION, *[F.round(n, 6).alias(n) for n in probs], (near[0] & near[1] & near[2]).alias("in_bound"))


@register("filter_residual", kept_sql(f"""
SELECT {KEY}, LapTimeResidual FROM (
  SELECT *, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS LapTimeResidual FROM kept) r
WHERE abs(LapTimeResidual) <= 3"""))
def filter_residual(spark, sf_dir):
    kept = filters.iqr_filter(base_laps(spark, sf_dir))
    return filters.residual_filter(features.session_baseline(kept), 3.0).select(*KEYS, "LapTimeResidual")


@register("filter_drop_missing", laps_sql(f"SELECT {KEY} FROM laps WHERE LapTime IS NOT NULL AND Compound IS NOT NULL"))
def filter_drop_missing(spark, sf_dir):
    return filters.drop_missing(data.laps(spark, sf_dir), ["LapTime", "Compound"]).select(*KEYS)


@register("filter_min_samples", samples_sql("""
SELECT session, driver, lap, avg(Speed) AS speed_mean, max(Speed) AS speed_max FROM samples
GROUP BY session, driver, lap HAVING count(*) >= 20"""))
def filter_min_samples(spark, sf_dir):
    laps = aggregates.lap_telemetry(data.telemetry_samples(spark, sf_dir), ["session", "driver", "lap"], min_samples=20)
    return laps.select("session", "driver", "lap", "speed_mean", "speed_max")


@register("filter_min_group_rows", base_sql(f"""
SELECT {KEY} FROM base WHERE (year, gp) IN (SELECT (year, gp) FROM base GROUP BY year, gp HAVING count(*) >= 300)"""))
def filter_min_group_rows(spark, sf_dir):
    return filters.groups_with_rows(base_laps(spark, sf_dir), ["year", "gp"], 300).select(*KEYS)


@register("filter_years", laps_sql(f"SELECT {KEY} FROM laps WHERE year IN (1999, 2000)"))
def filter_years(spark, sf_dir):
    return filters.in_years(data.laps(spark, sf_dir), [1999, 2000]).select(*KEYS)


@register("filter_tracks", laps_sql(f"""
SELECT {KEY} FROM laps WHERE gp IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_15', 'NATION_19')"""))
def filter_tracks(spark, sf_dir):
    return filters.in_tracks(data.laps(spark, sf_dir), TRACKS).select(*KEYS)


@register("filter_retention", laps_sql("""
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, rows_in, rows_out, 100 * rows_out / greatest(rows_in, 1) AS pct FROM (
  SELECT unnest([1, 2, 3, 4, 5]) AS stage_no, unnest(['PitOutTime', 'PitInTime', 'Deleted', 'gp', 'LapTime']) AS stage,
    unnest([n0, n1, n2, n3, n4]) AS rows_in, unnest([n1, n2, n3, n4, n5]) AS rows_out
  FROM (
    SELECT count(*) AS n0, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE a AND b) AS n2,
      count(*) FILTER (WHERE a AND b AND c) AS n3, count(*) FILTER (WHERE a AND b AND c AND d) AS n4,
      count(*) FILTER (WHERE a AND b AND c AND d AND e) AS n5
    FROM (SELECT PitOutTime IS NULL AS a, PitInTime IS NULL AS b, NOT coalesce(Deleted, false) AS c, gp <> 'NATION_0' AS d,
            LapTime IS NOT NULL AS e FROM laps) p) n) s"""))
def filter_retention(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    return filters.retention(laps, filters.basic_stages(laps.columns, excluded=EXCLUDED))

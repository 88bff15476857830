"""Splits and fold-safe encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.filters import base_laps
from lapforge.catalog.registry import KEY, TEST_YEAR, TRAIN_YEARS, base_sql, register
from lapforge.operators import encoding, splits

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]


def _laps(spark, sf_dir):
    return base_laps(spark, sf_dir).select(*KEYS, "Driver", "LapTime")


@register("split_leave_one_group_out", base_sql(f"""
SELECT {KEY}, CAST(dense_rank() OVER (ORDER BY gp) AS INTEGER) AS fold FROM base"""))
def split_leave_one_group_out(spark, sf_dir):
    return splits.leave_one_group_out(_laps(spark, sf_dir), "gp").select(*KEYS, "fold")


@register("split_group_kfold", "WITH RECURSIVE" + base_sql(f"""
SELECT {KEY}, CAST(fold AS INTEGER) AS fold FROM base JOIN placed_folds USING (gp)""", """
sized AS (SELECT gp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gp DESC) AS i FROM base GROUP BY gp),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS gp, CAST(-1 AS BIGINT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL
  SELECT s.i, s.gp, CAST(list_position(p.load, list_min(p.load)) - 1 AS BIGINT),
    list_transform(p.load, lambda x, j: CASE WHEN j = list_position(p.load, list_min(p.load)) THEN x + s.n ELSE x END)
  FROM greedy p JOIN sized s ON s.i = p.i + 1),
placed_folds AS (SELECT gp, fold FROM greedy WHERE i > 0)""").removeprefix("WITH"))
def split_group_kfold(spark, sf_dir):
    return splits.group_kfold(_laps(spark, sf_dir), "gp", 5).select(*KEYS, "fold")


@register("split_walk_forward", base_sql(f"""
SELECT {KEY}, CASE WHEN year = 2001 THEN 'test' ELSE 'train' END AS part FROM base WHERE year IN (1999, 2000, 2001)"""))
def split_walk_forward(spark, sf_dir):
    return splits.walk_forward(_laps(spark, sf_dir), TRAIN_YEARS, TEST_YEAR).select(*KEYS, "part")


@register("split_random", base_sql(f"""
SELECT {KEY}, CASE WHEN ('0x' || substr(md5(year || '|' || gp || '|' || session_code || '|' || DriverNumber || '|' || LapNumber || '|42'), 1, 8))::BIGINT % 100 < 80
  THEN 'train' ELSE 'test' END AS part FROM base"""))
def split_random(spark, sf_dir):
    return splits.random_split(_laps(spark, sf_dir), KEYS).select(*KEYS, "part")


@register("split_fold_rows", base_sql("""
SELECT CAST(dense_rank() OVER (ORDER BY gp) AS INTEGER) AS fold, CAST((SELECT count(*) FROM base) - count(*) AS BIGINT) AS train_rows, count(*) AS test_rows
FROM base GROUP BY gp"""))
def split_fold_rows(spark, sf_dir):
    from lapforge.operators.aggregates import fold_rows

    return fold_rows(splits.leave_one_group_out(_laps(spark, sf_dir), "gp"))


@register("encode_leave_fold_out", base_sql(f"""
SELECT {KEY}, fold, coalesce((s + 20 * gm) / (n + 20), gm) AS Driver_te FROM d
JOIN (SELECT f.fold, avg(LapTime) AS gm FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold GROUP BY f.fold) g USING (fold)
LEFT JOIN (SELECT f.fold, Driver, sum(LapTime) AS s, count(LapTime) AS n FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold
  GROUP BY f.fold, Driver) e USING (fold, Driver)""", """
d AS (SELECT *, CAST(dense_rank() OVER (ORDER BY gp) AS INTEGER) AS fold FROM base)"""))
def encode_leave_fold_out(spark, sf_dir):
    folds = splits.leave_one_group_out(_laps(spark, sf_dir), "gp")
    return encoding.leave_fold_out_encoding(folds, "LapTime", "Driver", "fold").select(*KEYS, "fold", "Driver_te")


@register("encode_leave_fold_out_own_group", base_sql(f"""
SELECT {KEY}, fold, gm AS gp_te FROM d
JOIN (SELECT f.fold, avg(LapTime) AS gm FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold GROUP BY f.fold) g USING (fold)""", """
d AS (SELECT *, CAST(dense_rank() OVER (ORDER BY gp) AS INTEGER) AS fold FROM base)"""))
def encode_leave_fold_out_own_group(spark, sf_dir):
    """A category seen only in its own fold gets the mean of the others."""
    folds = splits.leave_one_group_out(_laps(spark, sf_dir), "gp")
    return encoding.leave_fold_out_encoding(folds, "LapTime", "gp", "fold").select(*KEYS, "fold", "gp_te")


@register("encode_walk_forward", base_sql(f"""
SELECT {KEY}, part, coalesce(d.enc, gm) AS Driver_te, coalesce(g.enc, gm) AS gp_te FROM w
LEFT JOIN (SELECT Driver, (count(*) * avg(LapTime) + 20 * any_value(gm)) / (count(*) + 20) AS enc FROM w, m WHERE part = 'train' GROUP BY Driver) d USING (Driver)
LEFT JOIN (SELECT gp, (count(*) * avg(LapTime) + 20 * any_value(gm)) / (count(*) + 20) AS enc FROM w, m WHERE part = 'train' GROUP BY gp) g USING (gp), m""", """
w AS (SELECT *, CASE WHEN year = 2001 THEN 'test' ELSE 'train' END AS part FROM base WHERE year IN (1999, 2000, 2001)),
m AS (SELECT avg(LapTime) AS gm FROM w WHERE part = 'train')"""))
def encode_walk_forward(spark, sf_dir):
    marked = splits.walk_forward(_laps(spark, sf_dir), TRAIN_YEARS, TEST_YEAR)
    encoder = encoding.TargetEncoding(["Driver", "gp"]).fit(marked.where(F.col("part") == "train"), "LapTime")
    return encoder.transform(marked).select(*KEYS, "part", "Driver_te", "gp_te")

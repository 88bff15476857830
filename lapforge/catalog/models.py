"""Model runs. Linear ones are checked value by value. Boosted ones return their metrics, predictions and importances, which
depend on the trainer and so have no SQL; ``FACTS`` has SQL for those of their columns that don't (keys, targets, folds, row
counts, feature names, the trivial baseline), which the tests hold against them.

The number of trees, their depth and the trials are arguments of the plans, whose defaults are the full settings of
``constants.BOOSTER`` and the search ranges. The searches run with these; the other queries pass the shorter ones below.
"""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.aggregates import scored_laps
from lapforge.catalog.features import RACE_FEATURES_SQL, race_features
from lapforge.catalog.filters import base_laps
from lapforge.catalog.registry import KEY, TEST_YEAR, TRACKS, TRAIN_YEARS, WEIGHTS, kept_sql, laps_sql, register
from lapforge.functions import scalars as S
from lapforge.operators import aggregates, history, split_search, splits
from lapforge.plans import features as feature_plan
from lapforge.plans import reports, stages, training
from lapforge.plans.boosting import SearchBooster
from lapforge.session import fresh_path, written_table
from lapforge.sources import testdata as data

SHORT = {"n_estimators": 20, "max_depth": 5, "learning_rate": 0.1}
WALK = {"train_years": TRAIN_YEARS, "test_year": TEST_YEAR, "weights": WEIGHTS}
FINAL_WEIGHTS = {1999: 1.0, 2000: 2.0, 2001: 3.0}


def _inputs(spark, sf_dir):
    """Prepared race features as a written table: every fold and trial reads it, none recomputes it."""
    return written_table(training.prepare(race_features(spark, sf_dir)), "model-inputs")


#: Name of a query -> SQL for the columns that don't depend on the trainer.
FACTS: dict[str, str] = {}


def _trained(name: str, facts: str):
    FACTS[name] = facts
    return register(name)


_GREEDY = """
sized AS (SELECT gp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gp DESC) AS i FROM rated GROUP BY gp),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS gp, CAST(-1 AS BIGINT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL
  SELECT s.i, s.gp, CAST(list_position(p.load, list_min(p.load)) - 1 AS BIGINT),
    list_transform(p.load, lambda x, j: CASE WHEN j = list_position(p.load, list_min(p.load)) THEN x + s.n ELSE x END)
  FROM greedy p JOIN sized s ON s.i = p.i + 1),
rows_in AS (SELECT r.*, CAST(fold AS INTEGER) AS fold FROM rated r JOIN greedy USING (gp))"""
_NAMES = ", ".join(f"'{c}'" for c in [
    *(c for c in K.GLOBAL_CANDIDATES if c not in ("quali_position", "grid_position", "gap_to_pole_ms")),
    *(f"{c}_te" for c in K.ENCODED_CATEGORIES)])
_RATED = "rated AS (SELECT *, LapTimeResidual AS y FROM features)"
_OWN = "rows_in AS (SELECT *, CAST(dense_rank() OVER (ORDER BY gp) AS INTEGER) AS fold FROM rated)"
_COUNTS = """
SELECT fold, min(gp) AS test_gp, (SELECT count(*) FROM rows_in) - count(*) AS train_rows, count(*) AS test_rows
FROM rows_in GROUP BY fold"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


@_trained("model_walk_forward", kept_sql("""
SELECT count(*) FILTER (WHERE year IN (1999, 2000)) AS train_rows, count(*) FILTER (WHERE year = 2001) AS test_rows,
  round(stddev_samp(y) FILTER (WHERE year = 2001), 6) AS baseline_trivial_rmse FROM rated""", *RACE_FEATURES_SQL, _RATED))
def model_walk_forward(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    report = training.evaluate_walk_forward(df, training.available(df, K.GLOBAL_CANDIDATES), SHORT, **WALK)
    return report.withColumn("baseline_trivial_rmse", F.round("baseline_trivial_rmse", 6))


@_trained("model_group_kfold", _recursive(kept_sql(_COUNTS, *RACE_FEATURES_SQL, _RATED, _GREEDY)))
def model_group_kfold(spark, sf_dir):
    df = splits.with_year_weight(splits.group_kfold(_inputs(spark, sf_dir)), WEIGHTS)
    features = training.available(df, K.GLOBAL_CANDIDATES)
    return training.evaluate_folds(
        df, features, lambda: training.booster({**SHORT, "n_estimators": 10}, weight="weight"), range(K.GROUP_FOLDS),
        categories=K.ENCODED_CATEGORIES)


@_trained("model_leave_one_group_out", kept_sql(_COUNTS, *RACE_FEATURES_SQL, _RATED, _OWN))
def model_leave_one_group_out(spark, sf_dir):
    df = training.prepare_leave_one_out(_inputs(spark, sf_dir))
    folds = splits.leave_one_group_out(df, "gp")
    n = df.agg(F.count_distinct("gp")).first()[0]
    tree = lambda: DecisionTreeRegressor(labelCol=K.TARGET, featuresCol="features", maxDepth=4, seed=K.SPLIT_SEED)
    return training.evaluate_folds(
        folds, training.available(df, K.LEAVE_ONE_OUT_CANDIDATES), tree, range(1, n + 1), fill_zero=True, parallelism=4)


@_trained("model_search", kept_sql(f"""
SELECT CAST(trial AS INTEGER) AS trial FROM rated, range({K.GLOBAL_SEARCH["trials"]}) t(trial) GROUP BY trial""", *RACE_FEATURES_SQL, _RATED))
def model_search(spark, sf_dir):
    """All trials of the full ranges on the walk-forward split."""
    df = _inputs(spark, sf_dir)
    features = training.available(df, K.GLOBAL_CANDIDATES)

    def loss(params):
        estimator = SearchBooster(params, weight="weight")
        return training.evaluate_walk_forward(df, features, estimator=estimator, **WALK).first()["rmse"]

    return training.search(spark, training.draw_params(K.GLOBAL_SEARCH), loss, training.models_at_a_time(df))


@_trained("model_feature_importance", kept_sql(f"""
SELECT column_name AS feature FROM (SELECT unnest([{_NAMES}]) AS column_name) n
WHERE (SELECT count(*) FROM features) > 0""", *RACE_FEATURES_SQL))
def model_feature_importance(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    model, _, inputs = training.final_fit(
        df, training.available(df, K.GLOBAL_CANDIDATES), SHORT, weights=FINAL_WEIGHTS)
    return training.feature_importance(spark, model, inputs)


@_trained("model_scored_laps", kept_sql(f"SELECT {KEY}, y AS LapTimeResidual FROM rated", *RACE_FEATURES_SQL, _RATED))
def model_scored_laps(spark, sf_dir):
    """Fit on everything, save, load, score."""
    df, path = _inputs(spark, sf_dir), fresh_path(spark, "global-model")
    features = training.available(df, K.GLOBAL_CANDIDATES)
    model, encoder, _ = training.final_fit(df, features, SHORT, weights=FINAL_WEIGHTS)
    training.save_model(model, encoder, path)
    loaded, tables = training.load_model(spark, path)
    scored = training.score(df, loaded, tables, features)
    return scored.select(*K.LAP_GROUP, F.col(K.LAP_ORDER).cast("int").alias(K.LAP_ORDER), K.TARGET, "prediction")


@_trained("model_pit_classifier", laps_sql(f"""
SELECT CAST(TyreLife * 4 > {K.PIT_TYRE_LIFE} AS INTEGER) AS pit_label, count(*) AS n, avg(TyreLife * 4) AS mean_tyre_life FROM laps GROUP BY 1"""))
def model_pit_classifier(spark, sf_dir):
    laps = history.current_history(data.laps(spark, sf_dir)).withColumn("TyreLife", F.col("TyreLife") * 4)
    model = training.pit_classifier(laps, trees=20)
    scored = model.transform(training.doubles(laps, K.PIT_FEATURES, fill_zero=True))
    return scored.groupBy(S.pit_label().alias("pit_label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("TyreLife").alias("mean_tyre_life"), F.avg("prediction").alias("predicted_share"))


@_trained("model_local_tracks", kept_sql(f"""
SELECT gp, count(*) AS rows FROM rated WHERE gp IN ({", ".join(f"'{t}'" for t in TRACKS)}) GROUP BY gp
HAVING count(*) >= {K.MIN_TRACK_ROWS}""", *RACE_FEATURES_SQL, _RATED))
def model_local_tracks(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    return training.evaluate_tracks(
        df, TRACKS, training.available(df, K.LOCAL_CANDIDATES), key=[*K.LAP_GROUP, K.LAP_ORDER], space=K.LOCAL_SEARCH)


# --- linear models of every fold, checked value by value --------------------------------------------------------------
_LAPS_RATED = """
rated AS (SELECT gp, year, CAST(LapNumber AS DOUBLE) AS x,
  LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS y FROM kept)"""
_LINES = """
lines AS (SELECT f.fold, regr_slope(r.y, r.x) AS slope, regr_intercept(r.y, r.x) AS intercept, count(*) AS train_rows
  FROM (SELECT DISTINCT fold FROM rows_in) f JOIN rows_in r ON r.fold <> f.fold GROUP BY f.fold),
errors AS (SELECT r.fold, min(gp) AS test_gp, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
    1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2, min(train_rows) AS train_rows, count(*) AS test_rows
  FROM (SELECT r.*, intercept + slope * x AS p, train_rows FROM rows_in r JOIN lines USING (fold)) r GROUP BY r.fold)"""
_REPORT = """
SELECT fold, test_gp, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, train_rows, test_rows FROM errors"""


def _rated(spark, sf_dir):
    laps = feature_plan.surviving_laps(base_laps(spark, sf_dir))
    return laps.select("gp", "year", "LapNumber", K.TARGET)


def _six(report):
    return report.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


@register("model_linear_leave_one_group_out", kept_sql(_REPORT, _LAPS_RATED, _OWN, _LINES))
def model_linear_leave_one_group_out(spark, sf_dir):
    return _six(training.evaluate_linear_folds(splits.leave_one_group_out(_rated(spark, sf_dir)), ["LapNumber"])[0])


@register("model_linear_group_kfold", _recursive(kept_sql(_REPORT, _LAPS_RATED, _GREEDY, _LINES)))
def model_linear_group_kfold(spark, sf_dir):
    return _six(training.evaluate_linear_folds(splits.group_kfold(_rated(spark, sf_dir)), ["LapNumber"])[0])


@register("model_linear_best_fold", kept_sql("""
SELECT fold, test_gp, round(rmse, 6) AS rmse, round(intercept, 6) AS intercept, round(slope, 6) AS slope
FROM errors JOIN lines USING (fold) ORDER BY errors.rmse, fold LIMIT 1""", _LAPS_RATED, _OWN, _LINES))
def model_linear_best_fold(spark, sf_dir):
    """The model of the best fold is kept, not only its metrics."""
    best = training.best_fold_model(*training.evaluate_linear_folds(splits.leave_one_group_out(_rated(spark, sf_dir)), ["LapNumber"]))
    c = F.col("coefficients")
    return best.select("fold", "test_gp", F.round("rmse", 6).alias("rmse"), F.round(c[0], 6).alias("intercept"), F.round(c[1], 6).alias("slope"))


# --- leak-free encodings inside a cross-validated pipeline, and a search without refits ---------------------------------
_ENCODED = """
rated AS (SELECT gp, Driver, Team, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS y FROM kept)"""
_CODES = f"""
means AS (SELECT f, avg(y) AS gm FROM (SELECT DISTINCT fold AS f FROM rows_in) k JOIN rows_in r ON r.fold <> f GROUP BY f),
{{codes}},
coded AS (
  SELECT m.f, r.fold = m.f AS is_test, y, coalesce(d.e, gm) AS a, coalesce(t.e, gm) AS b, coalesce(g.e, gm) AS c
  FROM means m CROSS JOIN rows_in r LEFT JOIN code_Driver d ON d.f = m.f AND d.k = r.Driver
    LEFT JOIN code_Team t ON t.f = m.f AND t.k = r.Team LEFT JOIN code_gp g ON g.f = m.f AND g.k = r.gp),
moments AS (
  SELECT f, avg(y) AS y0, avg(a) AS a0, avg(b) AS b0, avg(c) AS c0, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc,
    covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(y, c) AS yc
  FROM coded WHERE NOT is_test GROUP BY f),
solved AS (
  SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
    ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc) AS da,
    aa * (yb * cc - yc * bc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac) AS db,
    aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac) AS dc
  FROM moments),
fold_errors AS (
  SELECT f, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / nullif(var_pop(y) * count(y), 0) AS r2, count(*) AS test_rows
  FROM (SELECT c.f, y, y - (y0 + da / det * (a - a0) + db / det * (b - b0) + dc / det * (c - c0)) AS e FROM coded c JOIN solved USING (f) WHERE is_test) t
  GROUP BY f)""".format(codes=",\n".join(f"""code_{c} AS (
  SELECT m.f, {c} AS k, (sum(y) + {K.ENCODING_SMOOTHING} * gm) / (count(y) + {K.ENCODING_SMOOTHING}) AS e
  FROM means m JOIN rows_in r ON r.fold <> m.f GROUP BY m.f, gm, {c})""" for c in K.ENCODED_CATEGORIES))


def _encoded(spark, sf_dir):
    laps = feature_plan.surviving_laps(base_laps(spark, sf_dir))
    return splits.group_kfold(laps.select("gp", "Driver", "Team", K.TARGET))


@register("model_encoded_group_kfold", _recursive(kept_sql("""
SELECT f AS fold, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, test_rows FROM fold_errors""", _ENCODED, _GREEDY, _CODES)))
def model_encoded_group_kfold(spark, sf_dir):
    """Driver, Team and gp as target means, fitted with the regression on the other folds only."""
    pipeline = stages.encoded_regression([], K.ENCODED_CATEGORIES)
    return _six(stages.cross_validated(_encoded(spark, sf_dir), pipeline, K.GROUP_FOLDS))


@register("model_encoded_cross_validator", _recursive(kept_sql("""
SELECT round(avg(rmse), 6) AS rmse FROM fold_errors""", _ENCODED, _GREEDY, _CODES)))
def model_encoded_cross_validator(spark, sf_dir):
    """The same pipeline as the estimator of Spark's CrossValidator over the fold column."""
    validator = stages.cross_validator(stages.encoded_regression([], K.ENCODED_CATEGORIES), K.GROUP_FOLDS)
    fitted = validator.fit(written_table(_encoded(spark, sf_dir), "folds"))
    return spark.createDataFrame([(round(float(fitted.avgMetrics[0]), 6),)], "rmse double")


_PENALTIES = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(training.draw_penalties()))


@register("model_ridge_search", kept_sql(f"""
SELECT CAST(trial AS INTEGER) AS trial, penalty,
  round(sqrt((syy - 2 * slope * sxy + slope * slope * sxx) / n + (y1 - y0 - slope * (x1 - x0)) * (y1 - y0 - slope * (x1 - x0))), 6) AS rmse
FROM (SELECT trial, penalty, sxy0 / (sxx0 + penalty) AS slope, x0, y0 FROM fitted, (VALUES {_PENALTIES}) v(trial, penalty)) c,
  (SELECT avg(x) AS x1, avg(y) AS y1, count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy
   FROM rated WHERE year = 2001) t""", _LAPS_RATED, """
weighted AS (SELECT *, CASE year WHEN 1999 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM rated WHERE year IN (1999, 2000)),
fitted AS (
  SELECT any_value(x0) AS x0, any_value(y0) AS y0, sum(w * (x - x0) * (y - y0)) AS sxy0, sum(w * (x - x0) * (x - x0)) AS sxx0
  FROM weighted, (SELECT sum(w * x) / sum(w) AS x0, sum(w * y) / sum(w) AS y0 FROM weighted) m)"""))
def model_ridge_search(spark, sf_dir):
    """Sixty penalties on the walk-forward split, season weights in the fit, from one pass over the rows."""
    marked = splits.with_year_weight(splits.walk_forward(_rated(spark, sf_dir), TRAIN_YEARS, TEST_YEAR), WEIGHTS)
    losses = training.ridge_losses(marked, ["LapNumber"], training.draw_penalties(), weight="weight")
    return losses.withColumn("rmse", F.round("rmse", 6))


# --- exact splits -------------------------------------------------------------------------------------------------------
SPLIT_FEATURES = ["LapNumber", "TyreLife", "Position", "speed_mean"]


def _thresholds_sql(rows: str, factor: str) -> str:
    """Every split of the rows (grp, feature, value, y) and the best of each feature."""
    return f"""
counts AS (SELECT grp, feature, value, count(*) AS n, sum(y) AS s FROM ({rows}) r WHERE value IS NOT NULL GROUP BY ALL),
along AS (
  SELECT grp, feature, value, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER g AS na, sum(s) OVER g AS sa
  FROM counts WINDOW w AS (PARTITION BY grp, feature ORDER BY value), g AS (PARTITION BY grp, feature)),
judged AS (
  SELECT *, (sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na) / na * {factor}::DOUBLE AS gain FROM along WHERE na > nl),
best AS (
  SELECT grp, feature, value AS threshold, gain, CAST(nl AS BIGINT) AS n_left, CAST(na - nl AS BIGINT) AS n_right, sl / nl AS left_mean, (sa - sl) / (na - nl) AS right_mean
  FROM judged QUALIFY row_number() OVER (PARTITION BY grp, feature ORDER BY gain DESC, value) = 1)"""


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("gain", "left_mean", "right_mean"))


def _six_of(df):
    return df.withColumns({c: F.round(c, 6) for c in ("gain", "left_mean", "right_mean")})


def _features_sql(table: str, y: str, group: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT {group} AS grp, '{f}' AS feature, CAST({'TyreLife * 4' if f == 'TyreLife' else f} AS DOUBLE) AS value, {y} AS y FROM {table}" for f in SPLIT_FEATURES)


@register("model_pit_stump", laps_sql(f"SELECT feature, threshold, {_ROUNDED}, n_left, n_right FROM best", _thresholds_sql(
    _features_sql("laps", f"CAST(coalesce(CAST(TyreLife * 4 > {K.PIT_TYRE_LIFE} AS INTEGER), 0) AS DOUBLE)"), "2")))
def model_pit_stump(spark, sf_dir):
    """The pit rule found again from its labels: the best Gini split of every feature, exactly."""
    laps = data.laps(spark, sf_dir).withColumn("TyreLife", F.col("TyreLife") * 4)
    return _six_of(split_search.best_thresholds(laps.withColumn("pit_label", S.pit_label()), SPLIT_FEATURES, "pit_label", gini=True))


@register("model_track_splits", kept_sql(f"""
SELECT grp AS gp, feature, threshold, {_ROUNDED}, n_left, n_right FROM best QUALIFY row_number() OVER (PARTITION BY grp ORDER BY gain DESC, feature) = 1""",
    "rated AS (SELECT *, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS y FROM kept)",
    _thresholds_sql(_features_sql("rated", "y", "gp"), "1")))
def model_track_splits(spark, sf_dir):
    """The best first split of the residual for every track."""
    laps = feature_plan.surviving_laps(base_laps(spark, sf_dir)).withColumn("TyreLife", F.col("TyreLife") * 4)
    return _six_of(split_search.best_split(split_search.best_thresholds(laps, SPLIT_FEATURES, K.TARGET, group="gp"), "gp"))


_PHASES = " ".join(f"WHEN pct <= {high}::DOUBLE THEN '{label}'" for high, label in zip(K.PHASE_EDGES[1:], K.PHASE_LABELS))


@register("report_model_diagnosis", kept_sql(f"""
SELECT CASE grouping(gp, Driver, race_phase) WHEN 7 THEN 'all' WHEN 3 THEN 'gp' WHEN 5 THEN 'driver' ELSE 'phase' END AS part,
  coalesce(gp, Driver, race_phase) AS name, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(stddev_samp(y), 6) AS spread, count(*) AS n
FROM (SELECT r.*, intercept + slope * x AS p, CASE {_PHASES} END AS race_phase FROM rows_in r JOIN lines USING (fold)) r
GROUP BY GROUPING SETS ((), (gp), (Driver), (race_phase))""", """
rated AS (SELECT gp, Driver, CAST(LapNumber AS DOUBLE) AS x, LapTime - median(LapTime) OVER (PARTITION BY year, gp, session_code) AS y,
  LapNumber / max(LapNumber) OVER (PARTITION BY year, gp, session_code) AS pct FROM kept)""", _OWN, _LINES))
def report_model_diagnosis(spark, sf_dir):
    """Errors of fitted models: every lap is predicted by the line of the other tracks."""
    folds = splits.leave_one_group_out(scored_laps(spark, sf_dir).drop("pred"))
    _, models = training.evaluate_linear_folds(folds, ["LapNumber"], target="y")
    scored = training.score_local_linear(folds, models, ["LapNumber"], group="fold", output="pred")
    return reports.diagnosis(scored).withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "spread")})


@register("model_linear_walk_forward", kept_sql("""
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 6) AS r2, count(*) AS n
FROM (SELECT y, (SELECT regr_intercept(y, x) FROM rated WHERE year IN (1999, 2000)) + x * (SELECT regr_slope(y, x) FROM rated WHERE year IN (1999, 2000)) AS p
  FROM rated WHERE year = 2001) s""", _LAPS_RATED))
def model_linear_walk_forward(spark, sf_dir):
    marked = splits.walk_forward(_rated(spark, sf_dir), TRAIN_YEARS, TEST_YEAR).withColumn("all", F.lit(1))
    model = training.fit_local_linear(marked.where("part = 'train'"), ["LapNumber"], group="all", ridge=0.0)
    scored = training.score_local_linear(marked.where("part = 'test'"), written_table(model, "walk-model"), ["LapNumber"], group="all", output="prediction")
    return _six(aggregates.error_metrics(scored, truth=K.TARGET, prediction="prediction"))

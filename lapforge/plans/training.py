"""Model work on Spark ML: inputs, fold-wise validation, search, final fit, scoring, local models.

Rows never leave the executors: encodings, weights, imputation and scoring are DataFrame steps, and metrics come back
as one-row aggregates. A run over folds or candidates is a driver loop over Spark jobs, a few at a time.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge import schemas
from lapforge.functions import scalars as S
from lapforge.operators import aggregates, encoding, splits
from lapforge.plans.boosting import SearchBooster
from lapforge.session import fresh_path, written_table


# --- inputs ------------------------------------------------------------------------------------------------------
def require_columns(df: DataFrame, columns: Sequence[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def available(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def covered(coverage: DataFrame, candidates: Sequence[str], pct: float) -> list[str]:
    """The candidates, in order, that at least ``pct`` per cent of the rows have; one row a column comes to the driver."""
    shares = {r.column_name: r.pct for r in coverage.where(F.col("column_name").isin(list(candidates))).collect()}
    return [c for c in candidates if (shares.get(c) or 0.0) >= pct]


def all_except(df: DataFrame, excluded: Sequence[str] = K.PER_TRACK_EXCLUDED) -> list[str]:
    return [c for c in df.columns if c not in excluded]


def prepare(df: DataFrame, candidates: Sequence[str] = K.GLOBAL_CANDIDATES, target: str = K.TARGET) -> DataFrame:
    """Candidates as finite numbers, rows without a target dropped."""
    numbers = {c: S.numeric(c) for c in available(df, [*candidates, target])}
    return df.withColumns(numbers).where(F.col(target).isNotNull())


def prepare_leave_one_out(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """The older preparation: adds tyre code, rain flag and ordinal codes where they are not there yet."""
    out = require_columns(df)
    if "CompoundEncoded" not in out.columns:
        require_columns(out, ["Compound"])
        out = out.withColumn("CompoundEncoded", S.compound_alias_code("Compound"))
    if "is_raining" not in out.columns:
        out = out.withColumn("is_raining", S.is_raining() if "Rainfall" in out.columns else F.lit(0))
    if "session_code_encoded" not in out.columns:
        out = encoding.ordinal_encode(out, "session_code", "session_code_encoded")
    if "team_encoded" not in out.columns:
        out = encoding.ordinal_encode(out, "Team", "team_encoded")
    return prepare(out, K.LEAVE_ONE_OUT_CANDIDATES, target)


# --- estimator -----------------------------------------------------------------------------------------------------
def booster(params: Mapping | None = None, *, label: str = K.TARGET, weight: str | None = None) -> GBTRegressor:
    """Gradient-boosted trees. Spark trees have no L1/L2 penalty; the minimum child weight becomes a row minimum."""
    p = {**K.BOOSTER, **(params or {})}
    model = GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol="prediction", seed=K.SPLIT_SEED,
        maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
        subsamplingRate=float(p["subsample"]), featureSubsetStrategy=str(float(p["colsample"])),
        minInstancesPerNode=int(p.get("min_child_weight", 1)),
    )
    return model.setWeightCol(weight) if weight else model


def regression(features: Sequence[str], estimator, *, fill_zero: bool = False) -> Pipeline:
    """Assembler (which pins the feature order) and estimator; missing inputs become means of the training rows."""
    if fill_zero:
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])
    filled = [f"{f}__in" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"), estimator,
    ])


#: Rows of a partition that a model is fitted on. Trees keep their rows in memory, partition by partition, at a few hundred bytes a row,
#: while a partition of well compressed files may hold tens of millions.
FIT_ROWS = 250_000


def fitted(pipeline: Pipeline, ready: DataFrame) -> PipelineModel:
    """``pipeline.fit(ready)``, but the last stage sees its columns alone, in parts of about FIT_ROWS rows.

    Rows that come in such parts (see :func:`parted_table`) stay where they are.
    """
    *before, estimator = pipeline.getStages()
    stages = []
    for stage in before:
        stages.append(stage.fit(ready) if isinstance(stage, Estimator) else stage)
        ready = stages[-1].transform(ready)
    params = [p for p in (estimator.featuresCol, estimator.labelCol, estimator.weightCol) if estimator.isDefined(p)]
    needed = ready.select(*[c for c in map(estimator.getOrDefault, params) if c])
    held = needed.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.max("n").alias("most")).first()
    parts = math.ceil(held["all"] / FIT_ROWS)
    if parts > ready.sparkSession.sparkContext.defaultParallelism and held.most > FIT_ROWS:
        needed = needed.repartition(parts)
    return PipelineModel([*stages, estimator.fit(needed)])


def parted_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, and read in partitions of at most FIT_ROWS rows: no file holds more, and each is read alone.

    So any number of models can be fitted on parts of it without a shuffle of its rows. That files aren't packed together is a setting of
    the session, so the table belongs to one of its own, with all other settings of the session of ``df``.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FIT_ROWS).parquet(path)
    reader = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            reader.conf.set(key, value)
    reader.conf.set("spark.sql.files.openCostInBytes", reader.conf.get("spark.sql.files.maxPartitionBytes"))
    return reader.read.schema(df.schema).parquet(path)


def doubles(df: DataFrame, features: Sequence[str], *, fill_zero: bool = False) -> DataFrame:
    out = df.withColumns({f: F.col(f).cast("double") for f in features})
    return out.na.fill(0.0, list(features)) if fill_zero else out


# --- validation ----------------------------------------------------------------------------------------------------
def fit_and_score(
    train: DataFrame, test: DataFrame, features: Sequence[str], estimator, *, target: str = K.TARGET,
    categories: Sequence[str] = (), fill_zero: bool = False,
) -> DataFrame:
    """Encode from the training rows only, fit on them, predict the test rows."""
    encoder = encoding.TargetEncoding(categories).fit(train, target)
    inputs = [*features, *encoder.feature_names]
    ready = doubles(encoder.transform(train), inputs, fill_zero=fill_zero)
    model = fitted(regression(inputs, estimator, fill_zero=fill_zero), ready)
    return model.transform(doubles(encoder.transform(test), inputs, fill_zero=fill_zero))


def evaluate_walk_forward(
    df: DataFrame, features: Sequence[str], params: Mapping | None = None, *, train_years=tuple(K.TRAIN_YEARS),
    test_year: int = K.TEST_YEAR, weights: Mapping[int, float] = K.YEAR_WEIGHTS, target: str = K.TARGET,
    categories: Sequence[str] = tuple(K.ENCODED_CATEGORIES), estimator=None,
) -> DataFrame:
    """Train on earlier seasons, test on the next: one row of metrics, baseline and row counts."""
    marked = splits.with_year_weight(splits.walk_forward(df, train_years, test_year), weights)
    train, test = (marked.where(F.col("part") == p) for p in ("train", "test"))
    model = estimator if estimator is not None else booster(params, label=target, weight="weight")
    scored = fit_and_score(train, test, features, model, target=target, categories=categories)
    train_rows = train.agg(F.count(F.lit(1))).scalar()
    report = aggregates.trivial_baseline(
        scored, truth=target, prediction="prediction", with_r2=True, more=[F.count(F.lit(1)).alias("test_rows")])
    return report.withColumn("train_rows", train_rows)


def evaluate_folds(
    df: DataFrame, features: Sequence[str], make_estimator: Callable[[], object], folds: Sequence[int], *,
    fold: str = "fold", target: str = K.TARGET, categories: Sequence[str] = (), fill_zero: bool = False,
    label: str = "gp", parallelism: int = 2,
) -> DataFrame:
    """Fit once per fold on the other folds. ``df`` carries the fold column and is written once for all folds.

    The columns that fits and report read are written alone, in parts that every fit reads as they are. ``parallelism`` folds run at a
    time, but fewer if they had more than four parts for a core: each keeps its rows in memory, or on disk what has no room there.
    """
    weight = make_estimator()
    weight = weight.getOrDefault("weightCol") if weight.hasParam("weightCol") and weight.isDefined("weightCol") else None
    kept = parted_table(df.select(*dict.fromkeys([fold, label, target, *features, *categories, *filter(None, [weight])])), "folds")
    room = 4 * FIT_ROWS * df.sparkSession.sparkContext.defaultParallelism
    parallelism = max(1, min(parallelism, room // max(1, kept.count())))

    def one(k: int) -> DataFrame:
        scored = fit_and_score(kept.where(F.col(fold) != k), kept.where(F.col(fold) == k), features,
                               make_estimator(), target=target, categories=categories, fill_zero=fill_zero)
        return aggregates.error_metrics(scored, truth=target, prediction="prediction").select(
            F.lit(k).alias(fold), "rmse", "mae", "r2")

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for part in pool.map(lambda k: one(k).collect(), folds) for r in part]
    results = df.sparkSession.createDataFrame(rows, f"{fold} int, rmse double, mae double, r2 double")
    names = kept.groupBy(fold).agg(F.min(label).alias(f"test_{label}"))
    out = results.join(names, fold).join(aggregates.fold_rows(kept, fold), fold).select(
        fold, f"test_{label}", "rmse", "mae", "r2", "train_rows", "test_rows")
    return out


# --- search --------------------------------------------------------------------------------------------------------
def draw_params(space: Mapping, trials: int | None = None, seed: int = K.SPLIT_SEED) -> list[dict]:
    """Seeded random candidates inside the documented ranges; learning rate on a log scale."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials or space["trials"]):
        low, high = np.log(space["learning_rate"])
        draws.append({
            "n_estimators": rng.randint(*space["n_estimators"]), "max_depth": rng.randint(*space["max_depth"]),
            "learning_rate": float(np.exp(rng.uniform(low, high))), "subsample": rng.uniform(*space["subsample"]),
            "colsample": rng.uniform(*space["colsample"]), "min_child_weight": rng.randint(*space["min_child_weight"]),
        })
    return draws


def models_at_a_time(df: DataFrame) -> int:
    """A model of few rows is fitted by one task, so that each core can have its own; a larger one has all cores."""
    return df.sparkSession.sparkContext.defaultParallelism if df.count() <= FIT_ROWS else 1


def search(
    spark: SparkSession, candidates: Sequence[Mapping], score: Callable[[Mapping], float], parallelism: int = 2
) -> DataFrame:
    """RMSE of every candidate, best first: ``trial, rmse`` and the parameters."""
    with ThreadPoolExecutor(parallelism) as pool:
        losses = list(pool.map(score, candidates))
    rows = [(i, float(loss), *[float(v) for v in c.values()]) for i, (c, loss) in enumerate(zip(candidates, losses))]
    names = ", ".join(f"{n} double" for n in candidates[0])
    return spark.createDataFrame(rows, f"trial int, rmse double, {names}").orderBy("rmse", "trial")


def ridge_losses(
    df: DataFrame, features: Sequence[str], penalties: Sequence[float], *, part: str = "part", target: str = K.TARGET, weight: str | None = None,
) -> DataFrame:
    """``trial, penalty, rmse`` of every candidate penalty, best first, from one pass over the rows marked train and test.

    A ridge regression and its error follow from sums of products: with those of the training rows the coefficients b solve
    (X'WX + penalty) b = X'Wy, the intercept not penalised, and with those of the test rows the squared error is the
    quadratic form y'y - 2 b'X'y + b'X'Xb. So a candidate costs no refit and no scoring. The driver sees two rows of
    products. Rows without a target are left out; missing features count as zero.
    """
    names = ["_1", *features]
    kept = df.where(F.col(target).isNotNull() & F.col(part).isin("train", "test"))
    # Around fixed points near the data products keep their digits; the shift goes into the intercept.
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    y = F.col(target).cast("double")
    at = kept.agg(*[F.coalesce(F.round(F.avg(c)), F.lit(0.0)) for c in [*values, y]]).first()
    values = [F.lit(1.0), *[v - F.lit(a) for v, a in zip(values, at)]]
    y = y - F.lit(at[-1])
    w = F.when(F.col(part) == "train", F.col(weight) if weight else F.lit(1.0)).otherwise(F.lit(1.0)).cast("double")
    size = len(names)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = kept.groupBy(part).agg(
        F.array(*[F.sum(w * values[i] * values[j]) for i, j in upper]).alias("xx"),
        F.array(*[F.sum(w * v * y) for v in values]).alias("xy"), F.sum(w * y * y).alias("yy"), F.sum(w).alias("n")).collect()
    found = {r[part]: r for r in sums}
    if set(found) != {"train", "test"}:
        raise ValueError("both training and test rows are needed")

    def square(flat) -> np.ndarray:
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = flat
        return m + np.triu(m, 1).T

    train, test = found["train"], found["test"]
    xx, xy, test_xx, test_xy = square(train.xx), np.array(train.xy), square(test.xx), np.array(test.xy)
    rows = []
    for i, penalty in enumerate(penalties):
        b = np.linalg.lstsq(xx + penalty * np.diag([0.0] + [1.0] * (size - 1)), xy, rcond=None)[0]
        loss = max(0.0, test.yy - 2 * b @ test_xy + b @ test_xx @ b) / test.n
        rows.append((i, float(penalty), float(np.sqrt(loss))))
    return df.sparkSession.createDataFrame(rows, "trial int, penalty double, rmse double").orderBy("rmse", "trial")


def draw_penalties(trials: int = K.GLOBAL_SEARCH["trials"], low: float = 1e-2, high: float = 1e8, seed: int = K.SPLIT_SEED) -> list[float]:
    """Seeded draws, even on a log scale."""
    rng = random.Random(seed)
    return [float(np.exp(rng.uniform(np.log(low), np.log(high)))) for _ in range(trials)]


# --- final model ----------------------------------------------------------------------------------------------------
def final_fit(
    df: DataFrame, features: Sequence[str], params: Mapping | None = None, *, target: str = K.TARGET,
    weights: Mapping[int, float] = K.FINAL_YEAR_WEIGHTS, categories: Sequence[str] = tuple(K.ENCODED_CATEGORIES),
) -> tuple[PipelineModel, encoding.TargetEncoding, list[str]]:
    """Fit encoder and model on all rows with the final season weights."""
    encoder = encoding.TargetEncoding(categories).fit(df, target)
    inputs = [*features, *encoder.feature_names]
    ready = doubles(splits.with_year_weight(encoder.transform(df), weights), inputs)
    return fitted(regression(inputs, booster(params, label=target, weight="weight")), ready), encoder, inputs


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(features, values))
    return spark.createDataFrame(rows, schemas.IMPORTANCE).orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel, encoder: encoding.TargetEncoding, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    encoder.save(f"{path}/encoder")


def load_model(spark, path: str, categories: Sequence[str] = tuple(K.ENCODED_CATEGORIES)):
    return PipelineModel.load(f"{path}/model"), encoding.TargetEncoding.load(spark, f"{path}/encoder", categories)


def score(df: DataFrame, model: PipelineModel, encoder: encoding.TargetEncoding, features: Sequence[str]) -> DataFrame:
    """Predictions next to the given columns; the assembler inside the model holds the feature order."""
    scored = model.transform(doubles(encoder.transform(df), [*features, *encoder.feature_names]))
    return scored.select(*df.columns, "prediction")


# --- one model per track ---------------------------------------------------------------------------------------------
def _moments(df: DataFrame, features: Sequence[str], group: str, target: str) -> DataFrame:
    """Sums of products of each group: ``n, xx, xy`` (upper triangle, constant first). Any skew is reduced before it moves."""
    names = ["_1", *features]
    values = {"_1": F.lit(1.0), **{f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}}
    y = F.col(target).cast("double")
    sums = [F.sum(values[a] * values[b]) for i, a in enumerate(names) for b in names[i:]]
    sums_y = [F.sum(values[a] * y) for a in names]
    return df.where(y.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"), F.array(*sums_y).alias("xy"))


def _solved(moments: DataFrame, size: int, group: str, ridge: float) -> DataFrame:
    """``group, n, coefficients`` (intercept first): only these small matrices are solved in Python."""
    upper = np.triu_indices(size)

    def solve(batches):
        for batch in batches:
            solved = []
            for xx, xy in zip(batch["xx"], batch["xy"]):
                m = np.zeros((size, size))
                m[upper] = xx
                m = m + np.triu(m, 1).T + ridge * np.diag([0.0] + [1.0] * (size - 1))
                solved.append(np.linalg.lstsq(m, np.asarray(xy, dtype=float), rcond=None)[0].tolist())
            yield pd.DataFrame({group: batch[group], "n": batch["n"], "coefficients": solved})

    kind = dict(moments.dtypes)[group]
    return moments.mapInPandas(solve, f"`{group}` {kind}, n bigint, coefficients array<double>")


def fit_local_linear(
    df: DataFrame, features: Sequence[str], *, group: str = "gp", target: str = K.TARGET, ridge: float = 1e-6,
) -> DataFrame:
    """A ridge regression per group: ``group, n, coefficients`` (intercept first)."""
    return _solved(_moments(df, features, group, target), len(features) + 1, group, ridge)


def fit_leave_fold_out(
    df: DataFrame, features: Sequence[str], *, fold: str = "fold", target: str = K.TARGET, ridge: float = 0.0,
) -> DataFrame:
    """For every fold the regression on all other folds: ``fold, n, coefficients``.

    Exact, from one pass: the sums of products of the other folds are those of all rows less the fold's own.
    """
    own = written_table(_moments(df, features, fold, target), "fold-moments")
    size = len(features) + 1
    width = {"xx": size * (size + 1) // 2, "xy": size}
    whole = own.agg(F.sum("n").alias("n_all"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(f"{c}_all") for c, k in width.items()])
    rest = own.join(F.broadcast(whole)).select(
        fold, (F.col("n_all") - F.col("n")).alias("n"),
        *[F.zip_with(f"{c}_all", c, lambda a, b: a - b).alias(c) for c in width])
    return _solved(rest, size, fold, ridge)


def evaluate_linear_folds(
    df: DataFrame, features: Sequence[str], *, fold: str = "fold", target: str = K.TARGET, label: str = "gp",
) -> tuple[DataFrame, DataFrame]:
    """Metrics of every fold under the regression on the other folds, and those regressions."""
    models = written_table(fit_leave_fold_out(df, features, fold=fold, target=target), "fold-models")
    scored = score_local_linear(df, models, features, group=fold, output="prediction")
    metrics = aggregates.error_metrics(scored, [fold], truth=target, prediction="prediction").withColumnRenamed("n", "test_rows")
    names = df.groupBy(fold).agg(F.min(label).alias(f"test_{label}"))
    report = metrics.join(names, fold).join(models.select(fold, F.col("n").alias("train_rows")), fold)
    return report.select(fold, f"test_{label}", "rmse", "mae", "r2", "train_rows", "test_rows"), models


def best_fold_model(report: DataFrame, models: DataFrame, *, fold: str = "fold", label: str = "gp") -> DataFrame:
    """The regression of the fold with the smallest RMSE: fold, the group it was tested on, its RMSE and coefficients."""
    best = report.agg(F.min(F.struct("rmse", fold, f"test_{label}")).alias("b")).select("b.*")
    return best.join(models.select(fold, "coefficients"), fold)


def score_local_linear(df: DataFrame, models: DataFrame, features: Sequence[str], *, group: str = "gp",
                       output: str = "pred_local") -> DataFrame:
    terms = F.col("coefficients")[0]
    for i, f in enumerate(features, start=1):
        terms = terms + F.col("coefficients")[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return df.join(models.select(group, "coefficients"), group, "left").withColumn(output, terms).drop("coefficients")


def local_fits(df: DataFrame, *, group: str = "gp", x: str = "LapNumber", y: str = K.TARGET) -> DataFrame:
    """Least-squares line of every group, as built-in aggregates."""
    return df.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("fit_r2"), F.regr_count(y, x).alias("n"),
    )


def pit_classifier(df: DataFrame, features: Sequence[str] = K.PIT_FEATURES, trees: int = 100) -> PipelineModel:
    """Forest on the pit rule. The label follows from a feature, so its accuracy says nothing."""
    ready = doubles(df.withColumn("pit_label", S.pit_label()), features, fill_zero=True)
    forest = RandomForestClassifier(labelCol="pit_label", featuresCol="features", numTrees=trees, seed=K.SPLIT_SEED)
    return fitted(regression(features, forest, fill_zero=True), ready)


def evaluate_tracks(
    df: DataFrame, tracks: Sequence[str], features: Sequence[str], *, key: Sequence[str], space: Mapping = K.LOCAL_SEARCH,
    trials: int | None = None, minimum: int = K.MIN_TRACK_ROWS, target: str = K.TARGET, parallelism: int | None = None,
) -> DataFrame:
    """A searched booster per listed track with enough rows: 80/20 split, best candidate, its metrics on the test part.

    ``parallelism`` candidates of a track are fitted at a time; if it isn't given, as :func:`models_at_a_time` has it.
    """
    spark = df.sparkSession
    listed = df.where(F.col("gp").isin(list(tracks))).groupBy("gp").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.gp: r.n for r in listed.where(F.col("n") >= minimum).collect()}
    candidates = draw_params(space, trials)

    def one(gp: str) -> tuple:
        marked = written_table(doubles(splits.random_split(df.where(F.col("gp") == gp), key), features, fill_zero=True), "track")
        train, test = (marked.where(F.col("part") == p) for p in ("train", "test"))

        def metrics(params: Mapping):
            model = fitted(regression(features, SearchBooster(params, label=target), fill_zero=True), train)
            return aggregates.error_metrics(model.transform(test), truth=target, prediction="prediction").first()

        with ThreadPoolExecutor(parallelism or models_at_a_time(marked)) as pool:
            best = min(pool.map(metrics, candidates), key=lambda m: m.rmse)
        return gp, best.rmse, best.mae, best.r2, sizes[gp]

    rows = [one(t) for t in tracks if t in sizes]
    return spark.createDataFrame(rows, schemas.LOCAL_RESULTS)

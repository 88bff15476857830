"""Pipeline stages: target encoding as a Spark ML estimator whose fitted tables are saved inside the pipeline.

``fit`` sees only the rows it is given, so inside a ``Pipeline`` under cross-validation a fold's test rows never touch the
means they are encoded with. The fitted model is an ordinary transformer: it takes batch and streaming frames alike (the
tables are joined as the static side), and ``PipelineModel.save`` writes its tables as Parquet beside its parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.operators import aggregates, encoding
from lapforge.session import written_table


class _EncoderParams(HasInputCols, HasOutputCols, HasLabelCol):
    smoothing = Param(Params._dummy(), "smoothing", "rows of the overall mean that a category's mean is mixed with", TypeConverters.toFloat)

    def output_names(self) -> list[str]:
        return self.getOutputCols() if self.isSet("outputCols") else [f"{c}_te" for c in self.getInputCols()]


class TargetEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Smoothed target means of categories. Fitting starts one Spark job for each category and writes its table."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None, labelCol: str = K.TARGET,
                 smoothing: float = K.ENCODING_SMOOTHING):
        super().__init__()
        self._setDefault(smoothing=K.ENCODING_SMOOTHING, labelCol=K.TARGET)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TargetEncoderModel:
        label, smoothing = self.getLabelCol(), self.getOrDefault(self.smoothing)
        tables = {c: written_table(encoding.fit_target_encoding(dataset, label, c, smoothing), "encoding") for c in self.getInputCols()}
        return self._copyValues(TargetEncoderModel(tables))


class TargetEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """Adds a column of encoded values for each category; missing and unseen ones get the mean of all training rows."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        super().__init__()
        self._setDefault(smoothing=K.ENCODING_SMOOTHING, labelCol=K.TARGET)
        self.tables = dict(tables or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for category, output in zip(self.getInputCols(), self.output_names(), strict=True):
            dataset = encoding.apply_target_encoding(dataset, category, self.tables[category], output)
        return dataset

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(MLWriter):
    def __init__(self, instance: TargetEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, category in enumerate(self.instance.getInputCols()):
            self.instance.tables[category].write.mode("overwrite").parquet(f"{path}/tables/{i}")


class _EncoderReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TargetEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {c: self.sparkSession.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(model.getInputCols())}
        return model


def encoded_regression(features: Sequence[str], categories: Sequence[str], *, target: str = K.TARGET, smoothing: float = K.ENCODING_SMOOTHING,
                       estimator=None) -> Pipeline:
    """Encoder, assembler and a linear regression (or another estimator); all are fitted on the same rows."""
    encoder = TargetEncoder(inputCols=list(categories), labelCol=target, smoothing=smoothing)
    inputs = [*features, *encoder.output_names()]
    return Pipeline(stages=[encoder, VectorAssembler(inputCols=inputs, outputCol="features"),
                            estimator or LinearRegression(labelCol=target, featuresCol="features", solver="normal")])


def cross_validated(df: DataFrame, estimator, folds: int, *, fold: str = "fold", target: str = K.TARGET, parallelism: int = 3) -> DataFrame:
    """RMSE, MAE and R2 of every fold (numbered from 0) under the estimator fitted on the other folds; empty folds are left out.

    ``df`` is written once. Each fold fits and scores as Spark jobs and gives back one row, a few folds at a time.
    """
    kept = written_table(df, "folds")

    def one(k: int) -> tuple:
        fitted = estimator.copy().fit(kept.where(F.col(fold) != k))
        found = aggregates.error_metrics(fitted.transform(kept.where(F.col(fold) == k)), truth=target, prediction="prediction").first()
        return k, found.rmse, found.mae, found.r2, found.n

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for r in pool.map(one, range(folds)) if r[-1]]
    return df.sparkSession.createDataFrame(rows, f"{fold} int, rmse double, mae double, r2 double, test_rows bigint")


def cross_validator(estimator, folds: int, *, fold: str = "fold", target: str = K.TARGET, grid=None, parallelism: int = 2) -> CrossValidator:
    """Spark's own cross-validation over a given fold column; its checks of the column run in Python, row by row."""
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(), numFolds=folds, foldCol=fold, parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="rmse"))


def load_pipeline(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.read().session(spark).load(path)

"""Readers and writers. CSV is supported; Parquet, partitioned by session type, is what a cluster should use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import schemas


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value instead of two: NaN becomes NULL in every floating column."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: str = schemas.LAPS) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("session_code",), mode: str = "overwrite"):
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_batch(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add a batch of laps; only the new rows are written. New columns are picked up by ``read_accumulated``."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_accumulated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def union_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames with the union of their columns; absent ones are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_checkpoint(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{completed: [...], failed: [...]}``, one state to a file or to a line -> rows (status, key)."""
    state = spark.read.schema(schemas.CHECKPOINT).option("multiLine", multi_line).json(path)
    rows = [state.select(F.lit(s).alias("status"), F.explode(s).alias("key")) for s in ("completed", "failed")]
    return rows[0].unionByName(rows[1])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_feature_list(spark: SparkSession, path: str, numeric: Sequence[str], categorical: Sequence[str]) -> None:
    ordered = [*numeric, *[f"{c}_te" for c in categorical]]
    row = [(list(numeric), list(categorical), ordered)]
    write_json(spark.createDataFrame(row, schemas.FEATURE_LIST).coalesce(1), path)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Ordered model features, one row each: ``position, feature``."""
    meta = spark.read.schema(schemas.FEATURE_LIST).option("multiLine", True).json(path)
    return meta.select(F.posexplode("all_features_in_order").alias("position", "feature"))


def write_feature_text(spark: SparkSession, path: str, features: Sequence[str]) -> None:
    spark.createDataFrame([(f,) for f in features], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_feature_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "feature")


def log_values(metrics: DataFrame, run_id: str, kind: str) -> DataFrame:
    """A row of named metrics or parameters -> long rows (run_id, kind, key, value)."""
    texts = [F.col(c).cast("string").alias(c) for c in metrics.columns]
    long = metrics.select(*texts).unpivot([], list(metrics.columns), "key", "value")
    return long.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "key", "value")


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("kind").parquet(path)

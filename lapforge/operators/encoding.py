"""Categories to numbers: ordinal codes, one-hot columns, smoothed target means, fold-safe target means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.constants import ENCODING_SMOOTHING
from lapforge.session import written_table


CODE_RANGES = 64


def category_codes(df: DataFrame, column: str, *, ranges: int = CODE_RANGES) -> DataFrame:
    """(value, code): position in sorted order, from 0. Starts Spark jobs.

    Distinct values are dealt into even ranges of the sorted order, whatever they begin with, ranked inside their range
    and shifted by the number of values in the ranges before.
    """
    values = df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    ranged = values.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id())
    ranged = written_table(ranged, "categories")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranged.withColumn("_place", place).join(sizes, "_range").select(
        column, (F.col("_place") + F.col("_before")).cast("int").alias("code")
    )


def ordinal_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Sorted-order code of every value, -1 for a missing one."""
    codes = category_codes(df, column).withColumnRenamed("code", output)
    return df.join(codes, column, "left").withColumn(output, F.coalesce(F.col(output), F.lit(-1)))


def one_hot(df: DataFrame, columns: Sequence[str], *, most: int = 10_000) -> DataFrame:
    """A 0/1 column per value (``column_value``) and one for missing (``column_nan``); the source column goes.

    The plan gets a column for every value, so a column with more than ``most`` values is refused: :func:`one_hot_long` takes
    any number.
    """
    out = df
    for column in columns:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column!r} has more than {most} values; use one_hot_long")
        out = out.withColumns({
            **{f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values)},
            f"{column}_nan": F.col(column).isNull().cast("int"),
        })
    return out.drop(*columns)


def one_hot_long(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The ones of the one-hot matrix: (key, ``feature``), where feature is ``column_value`` or ``column_nan``."""
    names = [F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in columns]
    return df.select(*key, F.explode(F.array(*names)).alias("feature"))


def fit_target_encoding(
    train: DataFrame, target: str, category: str, smoothing: float = ENCODING_SMOOTHING
) -> DataFrame:
    """(category, ``enc``, ``global_mean``): category means pulled toward the mean of all rows.

    The row with a NULL category carries the value for categories never seen.
    """
    m = F.lit(float(smoothing))
    sums = train.groupBy(category).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    overall = sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("global_mean"))
    mean, gm = F.try_divide(F.col("_s"), F.col("_n")), overall.scalar()
    smoothed = F.coalesce((F.col("_n") * mean + m * gm) / (F.col("_n") + m), gm)
    known = sums.where(F.col(category).isNotNull()).select(
        category, smoothed.alias("enc"), gm.alias("global_mean"))
    kind = dict(train.dtypes)[category]
    unseen = overall.select(F.lit(None).cast(kind).alias(category), F.col("global_mean").alias("enc"), "global_mean")
    return known.unionByName(unseen)


def apply_target_encoding(df: DataFrame, category: str, encoding: DataFrame, output: str | None = None) -> DataFrame:
    """Look the encoding up; missing and unseen categories get the global mean."""
    output = output or f"{category}_te"
    seen = encoding.where(F.col(category).isNotNull()).select(category, F.col("enc").alias(output))
    fallback = encoding.where(F.col(category).isNull()).select("global_mean").scalar()
    joined = df.join(seen, category, "left")
    return joined.select(*df.columns, F.coalesce(F.col(output), fallback).alias(output))


class TargetEncoding:
    """Several categories at once; fitted tables are DataFrames and can be written and read as Parquet."""

    def __init__(self, columns: Sequence[str], smoothing: float = ENCODING_SMOOTHING):
        self.columns, self.smoothing, self.tables = list(columns), smoothing, {}

    @property
    def feature_names(self) -> list[str]:
        return [f"{c}_te" for c in self.columns]

    def fit(self, train: DataFrame, target: str) -> TargetEncoding:
        self.tables = {c: fit_target_encoding(train, target, c, self.smoothing) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            df = apply_target_encoding(df, c, self.tables[c])
        return df

    def save(self, path: str) -> None:
        for c, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{c}")

    @classmethod
    def load(cls, spark, path: str, columns: Sequence[str], smoothing: float = ENCODING_SMOOTHING) -> TargetEncoding:
        loaded = cls(columns, smoothing)
        loaded.tables = {c: spark.read.parquet(f"{path}/{c}") for c in columns}
        return loaded


def leave_fold_out_encoding(
    df: DataFrame, target: str, category: str, fold: str, smoothing: float = ENCODING_SMOOTHING,
    output: str | None = None,
) -> DataFrame:
    """Encode each row from the rows of all other folds, for every fold at once. Starts a Spark job.

    Sums per (category, fold) are taken away from sums per category; nothing is fitted fold by fold. The rows are read
    once for the sums, which are written, and once to be encoded.
    """
    output, m = output or f"{category}_te", F.lit(float(smoothing))
    cells = written_table(df.groupBy(category, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n")), "cells")
    by_category = cells.groupBy(category).agg(F.sum("s").alias("s_c"), F.sum("n").alias("n_c"))
    by_fold = cells.groupBy(fold).agg(F.sum("s").alias("s_f"), F.sum("n").alias("n_f"))
    whole = cells.agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    n_rest, s_rest = F.col("n_c") - F.col("n"), F.coalesce(F.col("s_c"), F.lit(0.0)) - F.coalesce(F.col("s"), F.lit(0.0))
    value = F.when(n_rest > 0, (s_rest + m * F.col("_gm")) / (n_rest + m)).otherwise(F.col("_gm"))
    # One row, joined as such: cross joining it costs nothing and keeps the plan at one read of the sums.
    rest = by_fold.join(F.broadcast(whole)).select(
        fold, F.try_divide(F.col("s_all") - F.col("s_f"), F.col("n_all") - F.col("n_f")).alias("_gm"))
    rest = written_table(rest, "other-folds")
    table = cells.join(by_category, category).join(rest, fold).select(category, fold, value.alias(output))
    return (
        df.join(table, [category, fold], "left").join(rest, fold, "left")
        .withColumn(output, F.coalesce(F.col(output), F.col("_gm"))).select(*df.columns, output)
    )

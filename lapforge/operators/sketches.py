"""Quantile sketches that are stored, added up and asked again without the rows.

A value is counted in a bin of its sign and of the power of ``(1 + a) / (1 - a)`` next above its size, so the middle of a bin is
within the share ``a`` of every value in it. A sketch is a table (keys, bin, n); two sketches of the same keys are merged by
adding their counts, in any order, which makes the result independent of batches. A key has at most some
``log(largest / smallest) / (2 a)`` bins, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ERROR = 0.0005
#: Larger than the number of any power of the base that a double can reach, so that bins order as values do.
_SHIFT = 1 << 24


def _base(error: float) -> float:
    return (1 + error) / (1 - error)


def value_bin(value: Column, error: float = ERROR) -> Column:
    power = F.ceil(F.log(F.abs(value)) / F.lit(math.log(_base(error)))) + F.lit(_SHIFT)
    return F.when(value == 0, F.lit(0)).otherwise(F.when(value > 0, power).otherwise(-power)).cast("bigint")


def bin_value(number: Column, error: float = ERROR) -> Column:
    middle = F.pow(F.lit(_base(error)), (F.abs(number) - F.lit(_SHIFT)).cast("double")) * F.lit(2 / (_base(error) + 1))
    return F.when(number == 0, F.lit(0.0)).otherwise(F.when(number > 0, middle).otherwise(-middle))


def sketch(df: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """(keys, bin, n): one pass, combined in the map tasks. Missing and infinite values are not counted."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(finite).groupBy(*keys, value_bin(v, error).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def store(part: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's sketch; the same batch again takes the place of what it left before."""
    part.write.mode("overwrite").parquet(f"{path}/_batch={batch}")


def merged(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The sketch of all batches stored under ``path``."""
    return spark.read.option("basePath", path).parquet(path).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def sketched_quantiles(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float], error: float = ERROR) -> DataFrame:
    """Each quantile within the share ``error`` of the value of rank floor(p * (n - 1)); the windows run over bins, not rows."""
    group = Window.partitionBy(*keys)
    along = counts.withColumn("_upto", F.sum("n").over(group.orderBy("bin"))).withColumn("_all", F.sum("n").over(group))
    found = along.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("bin"))).alias(n) for n, p in probs.items()])
    return found.select(*keys, *[bin_value(F.col(n), error).alias(n) for n in probs])

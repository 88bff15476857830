"""The best threshold of every feature, exactly, for all groups at once.

A split ``feature <= threshold`` is judged by what it takes off the target's variance (or, for a 0/1 target, off its Gini
impurity). Both follow from the number of rows and the sum of the target on either side, so the rows are first counted per
value of a feature, with a combine in the map tasks, and running sums over the values in order give every candidate. The
running sums are those of ``segments``: a feature with very many values is cut, not gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.segments import EXTRA, SEGMENT_ROWS, open_segments
from lapforge.session import written_table

_ALL = "_all"


def value_counts(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value, n, s): rows and target sum of every value. Missing values and targets are left out."""
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = df.select(*keys, F.col(target).cast("double").alias("_y"), listed.alias("_x")).select(*keys, "_y", "_x.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("_y").isNotNull()).groupBy(*keys, "feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))


def best_thresholds(
    df: DataFrame, features: Sequence[str], target: str, *, group: str | None = None, gini: bool = False, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Best split of every feature: (group,) feature, threshold, gain, n_left, n_right, left_mean, right_mean.

    The gain is the variance, or Gini impurity, less that of the two sides weighted by their rows. Of equal gains the
    smallest threshold counts; a feature with a single value has no split and no row. Rows without a group are left out.
    Starts Spark jobs.
    """
    source, keys = (df.where(F.col(group).isNotNull()), [group]) if group else (df.withColumn(_ALL, F.lit(0)), [_ALL])
    keys = [*keys, "feature"]
    counts = written_table(value_counts(source, features, target, keys[:1]), "value-counts")
    s = open_segments(counts, keys, ["value"], sums={"n": F.col("n"), "s": F.col("s")}, rows=rows)

    def upto(column: str) -> Column:
        local = F.sum(F.when(~F.col(EXTRA), F.col(column))).over(s.running())
        return F.coalesce(local, F.lit(0)) + F.coalesce(s.carried(column), F.lit(0))

    along = s.close(s.frame.withColumns({"n_left": upto("n"), "s_left": upto("s")}))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    n_right, s_right = F.col("n_all") - F.col("n_left"), F.col("s_all") - F.col("s_left")
    squares = F.col("s_left") * F.col("s_left") / F.col("n_left") + s_right * s_right / n_right - F.col("s_all") * F.col("s_all") / F.col("n_all")
    gain = squares / F.col("n_all") * F.lit(2.0 if gini else 1.0)
    found = along.join(totals, keys).where(n_right > 0).select(
        *keys, F.struct(
            gain.alias("gain"), (-F.col("value")).alias("order"), F.col("value").alias("threshold"), F.col("n_left").cast("bigint").alias("n_left"),
            n_right.cast("bigint").alias("n_right"), (F.col("s_left") / F.col("n_left")).alias("left_mean"), (s_right / n_right).alias("right_mean")).alias("b"))
    best = found.groupBy(*keys).agg(F.max("b").alias("b"))
    return best.select(*([group] if group else []), "feature", *[f"b.{c}" for c in ("threshold", "gain", "n_left", "n_right", "left_mean", "right_mean")])


def best_split(thresholds: DataFrame, group: str | None = None) -> DataFrame:
    """The feature with the largest gain, for each group; of equal gains the first by name."""
    keys = [group] if group else []
    rest = [c for c in thresholds.columns if c not in keys]
    largest = thresholds.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("_o"), *rest)).alias("b"))
    return largest.select(*keys, *[f"b.{c}" for c in rest])

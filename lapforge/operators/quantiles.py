"""Exact quantiles per group, also for a group too large for one task.

Groups of up to ``SMALL_GROUP`` values use the built-in exact percentile. Larger groups, found by a narrow count
first, are spread, with the same result to the last bit: rows collapse to (group, value, count) with map-side combine,
values fall into bins of about 0.02 % relative width at every magnitude, bin sizes say which bin holds a wanted rank,
bins that hold one are cut again into even parts between their least and greatest value, only the values of the parts
wanted are ordered, and linear interpolation follows. Two steps leave at most about a million different doubles in a
part. NaN counts as a value above infinity, as it does for the built-in percentile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.session import listed

SMALL_GROUP = 4_000_000
BINS_PER_OCTAVE = 4096
PARTS = 1 << 20
_TOP = 1100 * BINS_PER_OCTAVE


def _bin(value: Column) -> Column:
    """A coarse number that never decreases with the value, as fine near zero as elsewhere."""
    size = F.when(value == 0, 0).when(F.abs(value) == float("inf"), 2 * _TOP).otherwise(
        F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + _TOP)
    return F.when(F.isnan(value), 2 * _TOP + 1).otherwise(F.signum(value) * size).cast("int")


def _holding(counts: DataFrame, keys: Sequence[str], by: str, start: Column, wanted: Sequence[Column]) -> DataFrame:
    """The bins (``by``) that hold a wanted rank, with the number of values before them (``_start``)."""
    before = F.sum("_in").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return (
        counts.withColumn("_start", start + F.coalesce(before, F.lit(0)))
        .where(reduce(Column.__or__, [(F.col("_start") <= r) & (r < F.col("_start") + F.col("_in")) for r in wanted]))
    )


def _spread_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    keys = list(keys)

    def ranks(prob: float) -> tuple[Column, Column]:
        exact = F.lit(float(prob)) * (F.col("_size") - 1)
        return F.floor(exact), F.ceil(exact)

    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).agg(F.count(F.lit(1)).alias("_count"))
    )
    wanted = [r for p in probs.values() for r in ranks(p)]
    binned = counts.withColumn("_bin", _bin(F.col("_v")))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_count").alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    bins = bins.withColumn("_size", F.sum("_in").over(Window.partitionBy(*keys)))
    bins = _holding(bins, keys, "_bin", F.lit(0), wanted).select(*keys, "_bin", "_start", "_size", "_from", "_to")
    share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    part = F.when(F.col("_to") > F.col("_from"), F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    parted = binned.join(bins, [*keys, "_bin"]).withColumn("_part", part)
    parts = parted.groupBy(*keys, "_bin", "_part").agg(F.sum("_count").alias("_in"), F.first("_start").alias("_start"), F.first("_size").alias("_size"))
    parts = _holding(parts, [*keys, "_bin"], "_part", F.col("_start"), wanted).select(*keys, "_bin", "_part", F.col("_start").alias("_at"))
    upto = F.col("_at") + F.sum("_count").over(
        Window.partitionBy(*keys, "_bin", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = parted.join(parts, [*keys, "_bin", "_part"]).withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_count") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    ends = [c for name, p in probs.items() for c in (
        at(ranks(p)[0]).alias(f"_{name}_low"), at(ranks(p)[1]).alias(f"_{name}_high"))]
    picked = ranked.groupBy(*keys).agg(F.max("_size").alias("_size"), *ends)

    def between(name: str, prob: float) -> Column:
        exact = F.lit(float(prob)) * (F.col("_size") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        mixed = (F.ceil(exact) - exact) * low + (exact - F.floor(exact)) * high
        return F.when(F.ceil(exact) == F.floor(exact), low).when(low == high, low).otherwise(mixed).alias(name)

    return picked.select(*keys, *[between(n, p) for n, p in probs.items()])


def _builtin_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    every = F.percentile(F.col(value).cast("double") + F.lit(0.0), list(probs.values())).alias("_all")
    names = [F.col("_all")[i].alias(n) for i, n in enumerate(probs)]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(every).select(*keys, *names)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], large: DataFrame | None
) -> DataFrame:
    """One row per group: ``name -> quantile`` for every entry of ``probs``. ``large`` names the groups to spread."""
    if large is None:
        return _builtin_quantiles(df, keys, value, probs)
    small = _builtin_quantiles(df.join(large, list(keys), "left_anti"), keys, value, probs)
    return small.unionByName(_spread_quantiles(df.join(large, list(keys), "left_semi"), list(keys), value, probs))


def large_groups(df: DataFrame, keys: Sequence[str], value: str, rows: int = SMALL_GROUP) -> DataFrame | None:
    """Keys of the groups with more than ``rows`` values, or None. There are at most ``all rows / rows`` of them."""
    counted = df.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") > rows).select(*keys)
    return listed(counted)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, rows: int = SMALL_GROUP
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group; groups without values are left out."""
    return quantiles(df, keys, value, probs, large_groups(df, keys, value, rows))


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = 10_000
) -> DataFrame:
    """One-pass sketch for callers that accept a rank error of ``1 / accuracy``."""
    return df.groupBy(*keys).agg(*[
        F.percentile_approx(value, p, accuracy).cast("double").alias(n) for n, p in probs.items()
    ])

"""Row filters. All of them are plain predicates or a join with a small per-group table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.constants import EXCLUDED_GPS, IQR_FACTOR, MIN_TRACK_ROWS, SESSION
from lapforge.operators.quantiles import SMALL_GROUP, approximate_quantiles, group_quantiles
from lapforge.session import written_table


def basic_stages(
    columns: Sequence[str], *, excluded: Sequence[str] = EXCLUDED_GPS, gp: str = "gp", value: str = "LapTime"
) -> dict[str, Column]:
    """Name -> predicate of the basic filter, in order; tests on absent optional columns are skipped."""
    stages: dict[str, Column] = {}
    for pit in ("PitOutTime", "PitInTime"):
        if pit in columns:
            stages[pit] = F.col(pit).isNull()
    if "Deleted" in columns:
        stages["Deleted"] = ~F.coalesce(F.col("Deleted"), F.lit(False))
    if excluded:
        stages["gp"] = ~F.coalesce(F.col(gp).isin(list(excluded)), F.lit(False))
    stages[value] = F.col(value).isNotNull()
    return stages


def basic_filter(df: DataFrame, **options) -> DataFrame:
    """Keep timed, undeleted laps outside the pits and outside excluded events."""
    return df.where(reduce(Column.__and__, basic_stages(df.columns, **options).values()))


def retention(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, in one pass: ``stage_no, stage, rows_in, rows_out, pct``."""
    passed, so_far = [F.count(F.lit(1)).alias("n0")], F.lit(True)
    for i, condition in enumerate(stages.values(), start=1):
        so_far = so_far & condition
        passed.append(F.count_if(so_far).alias(f"n{i}"))
    cells = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"),
                 F.col(f"n{i - 1}").alias("rows_in"), F.col(f"n{i}").alias("rows_out"))
        for i, name in enumerate(stages, start=1)
    ])
    share = F.lit(100.0) * F.col("rows_out") / F.greatest(F.col("rows_in"), F.lit(1))
    return df.agg(*passed).select(F.inline(cells)).withColumn("pct", share)


def session_is(df: DataFrame, code: str) -> DataFrame:
    return df.where(F.col("session_code") == code)


def iqr_fences(quartiles: DataFrame, factor: float = IQR_FACTOR) -> DataFrame:
    """Quartiles ``_q1``/``_q3`` -> inclusive bounds ``_low``/``_high``."""
    width = F.col("_q3") - F.col("_q1")
    return (
        quartiles.withColumn("_low", F.col("_q1") - F.lit(factor) * width)
        .withColumn("_high", F.col("_q3") + F.lit(factor) * width)
        .drop("_q1", "_q3")
    )


#: The quantiles that fences are made of, by the names that they are expected under.
QUARTILES = {"_q1": 0.25, "_q3": 0.75}


def iqr_filter(
    df: DataFrame, *, keys: Sequence[str] = SESSION, value: str = "LapTime", factor: float = IQR_FACTOR,
    approximate: bool = False, quartiles: DataFrame | None = None, rows: int = SMALL_GROUP,
) -> DataFrame:
    """Keep values inside the quartile fences of their group. The fences, one row per group, are written out first.

    ``quartiles`` (keys, ``_q1``, ``_q3``) may come from stored sketches; else they are computed from ``df``, exactly unless
    ``approximate``.
    """
    if quartiles is None:
        quartiles = approximate_quantiles(df, keys, value, QUARTILES) if approximate else group_quantiles(df, keys, value, QUARTILES, rows=rows)
    fences = written_table(iqr_fences(quartiles, factor), "fences")
    return (
        df.join(fences, list(keys))
        .where(F.col(value).between(F.col("_low"), F.col("_high")))
        .select(*df.columns)
    )


def residual_filter(df: DataFrame, limit: float, value: str = "LapTimeResidual") -> DataFrame:
    return df.where(F.abs(F.col(value)) <= limit)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def groups_with_rows(df: DataFrame, keys: Sequence[str], minimum: int = MIN_TRACK_ROWS) -> DataFrame:
    """Keep groups with at least ``minimum`` rows: counted with map-side combine, joined back."""
    keys = list(keys)
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(*keys)
    return df.join(enough, keys, "left_semi")


def in_years(df: DataFrame, years: Sequence[int], column: str = "year") -> DataFrame:
    return df.where(F.col(column).isin(list(years)))


def in_tracks(df: DataFrame, tracks: Sequence[str], column: str = "gp") -> DataFrame:
    return df.where(F.col(column).isin(list(tracks)))

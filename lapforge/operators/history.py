"""Ordered per-driver features: only earlier laps feed a ``*_prev`` column.

Each ``*_columns`` helper returns expressions over an opened :class:`Segments` frame, so that a plan can open the
frame once and evaluate them all behind one shuffle; the functions below wrap them as stand-alone operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions import scalars as S
from lapforge.operators.segments import SEGMENT_ROWS, EXTRA, Segments, open_segments, running_sum

LOOKBACK = 5


def lap_time_columns(s: Segments, value: str = "LapTime") -> dict[str, Column]:
    v, w = F.col(value), s.ordered()
    out = {
        "lap_time_prev": F.lag(v, 1).over(w),
        "lap_time_mean_3_prev": F.avg(v).over(s.previous(3)),
        "lap_time_delta_prev": F.lag(v, 1).over(w) - F.lag(v, 2).over(w),
        "lap_time_std_5_prev": F.stddev_samp(v).over(s.previous(5)),
    }
    return {name: s.keyed(c) for name, c in out.items()}


def telemetry_columns(s: Segments, columns: Sequence[str]) -> dict[str, Column]:
    w, out = s.ordered(), {}
    for name in columns:
        out[f"{name}_prev"] = s.keyed(F.lag(name, 1).over(w))
        out[f"{name}_delta_prev"] = s.keyed(F.lag(name, 1).over(w) - F.lag(name, 2).over(w))
    return out


def tyre_columns(s: Segments) -> dict[str, Column]:
    return {"tyre_ratio": s.keyed(F.try_divide(F.col("TyreLife"), F.max("TyreLife").over(s.whole())))}


def stint_columns(s: Segments) -> dict[str, Column]:
    """These order rows by stint as well: evaluate them last, so that the rows are sorted twice and not three times."""
    progress = F.try_divide(s.position_within(), s.size_within())
    return {"stint_progress": s.keyed(F.when(F.col("Stint").isNotNull(), progress))}


def neutralization_columns(s: Segments, flag: Column) -> dict[str, Column]:
    """Laps since the last neutralized lap; the count starts as if one had happened long before lap 1.

    Needs a column ``_position`` and the carried mark ``neutralized``.
    """
    reached = F.last(F.when(~F.col(EXTRA) & (flag == 1), F.col("_position")), ignorenulls=True).over(s.running())
    last = F.coalesce(reached, s.carried("neutralized"), F.lit(-K.NEUTRALIZATION_START))
    return {"laps_since_neutralization": s.keyed((F.col("_position") - last).cast("bigint"))}


# --- stand-alone operators ---------------------------------------------------------------------------------------
def lap_time_history(
    df: DataFrame, keys: Sequence[str] = K.LAP_GROUP, order: str = K.LAP_ORDER, value: str = "LapTime",
    *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    s = open_segments(df, keys, [order], depth=LOOKBACK, rows=rows)
    return s.close(s.frame.withColumns(lap_time_columns(s, value)))


def telemetry_history(
    df: DataFrame, columns: Sequence[str] = K.TELEMETRY_COLUMNS, keys: Sequence[str] = K.LAP_GROUP,
    order: str = K.LAP_ORDER, *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    s = open_segments(df, keys, [order], depth=2, rows=rows)
    return s.close(s.frame.withColumns(telemetry_columns(s, present)))


def derived_scores(df: DataFrame) -> DataFrame:
    """Scores over the previous lap; a score whose inputs are absent is left out."""
    have = set(df.columns)
    out = {"degradation_score_prev": S.degradation_score()}
    if {"throttle_mean_prev", "brake_ratio_prev"} <= have:
        out["aggression_score_prev"] = S.aggression_score()
    if {"speed_mean_prev", "rpm_mean_prev"} <= have:
        out["efficiency_score_prev"] = S.efficiency_score()
    if {"drs_ratio_prev", "speed_max_prev"} <= have:
        out["drs_usage_intensity_prev"] = S.drs_intensity()
    out["consistency_score_prev"] = F.col("lap_time_std_5_prev")
    return df.withColumns(out)


def tyre_and_stint(
    df: DataFrame, keys: Sequence[str] = K.LAP_GROUP, order: str = K.LAP_ORDER, *, rows: int = SEGMENT_ROWS
) -> DataFrame:
    s = open_segments(df, keys, [order], maxima=["TyreLife"], within="Stint", rows=rows)
    return s.close(s.frame.withColumns(tyre_columns(s) | stint_columns(s)))


def laps_since_neutralization(
    df: DataFrame, keys: Sequence[str] = K.LAP_GROUP, order: str = K.LAP_ORDER, flag: str = "is_neutralized",
    *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    s = open_segments(df, keys, [order], marks={"neutralized": F.col(flag) == 1}, rows=rows)
    placed = s.frame.withColumn("_position", s.position())
    return s.close(placed.withColumns(neutralization_columns(s, F.col(flag)))).drop("_position")


def group_maximum(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Attach the group maximum: partial aggregate and a join back, so a hot group never meets in one task."""
    keys = list(keys)
    return df.join(df.groupBy(*keys).agg(F.max(value).alias(output)), keys, "left")


def race_progress(df: DataFrame, version: str = "v4") -> DataFrame:
    """``LapNumber_pct`` and its products; v4 measures against the session, v3 against the driver's own laps."""
    scope = K.SESSION if version == "v4" else K.LAP_GROUP
    return (
        group_maximum(df, scope, "LapNumber", "_laps")
        .withColumn("LapNumber_pct", F.try_divide(F.col("LapNumber"), F.col("_laps")))
        .withColumn("tyre_x_progress", F.col("TyreLife") * F.col("LapNumber_pct"))
        .withColumn("compound_x_tyre", F.col("CompoundEncoded") * F.col("TyreLife"))
        .drop("_laps")
    )


def current_history(
    df: DataFrame, keys: Sequence[str] = K.LAP_GROUP, order: str = K.LAP_ORDER, value: str = "LapTime",
    *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """What a live model knows before a lap is driven: mean of the last three laps, last change, tyre age ratio."""
    s = open_segments(df, keys, [order], depth=3, rows=rows)
    w = s.ordered()
    return s.close(s.frame.withColumns({
        "lap_time_mean_3": F.coalesce(F.avg(value).over(s.previous(3)), F.lit(K.DEFAULT_LAP_TIME)),
        "lap_time_delta": F.coalesce(F.lag(value, 1).over(w) - F.lag(value, 2).over(w), F.lit(0.0)),
        "tyre_ratio": F.col("TyreLife") / F.lit(K.TYRE_LIFE_SCALE),
    }))


def running_race_time(
    df: DataFrame, keys: Sequence[str] = K.LAP_GROUP, order: str = K.LAP_ORDER, value: str = "LapTime",
    pit: str = "pit", *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    cost = F.col(value) + F.lit(K.PIT_LOSS_SECONDS) * F.col(pit)
    return running_sum(df, keys, [order], cost, "total_time", rows=rows)

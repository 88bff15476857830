"""The feature plan: raw laps of one session type -> model-ready laps, only earlier laps feeding ``*_prev`` columns.

Step order matters and is kept: basic filter, session split, outlier fences, history over the surviving laps, target,
recent form, residual cut. Laps cut by the residual have already fed their neighbours' history.

Shape of the plan. The wide rows are shuffled once, by driver session, and every ordered window runs on that one
exchange. All the rest reaches the rows as small tables computed from narrow column-pruned reads and written out, so
that their size is known when the wide plan is made: outlier fences and session median (one row per session), race
length and form (one row per session and driver).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions import scalars as S
from lapforge.operators import filters, history
from lapforge.operators.aggregates import recent_form
from lapforge.operators.quantiles import SMALL_GROUP, group_quantiles, large_groups, quantiles
from lapforge.operators.segments import SEGMENT_ROWS, open_segments
from lapforge.session import written_table


def session_statistics(laps: DataFrame, factor: float = K.IQR_FACTOR, *, rows: int = SMALL_GROUP) -> DataFrame:
    """Per session: outlier fences, and the median of the lap times inside them. Starts Spark jobs.

    The fences are written first, so that the lap times meet a table of known size and only their counts move by session.
    """
    large = large_groups(laps, K.SESSION, "LapTime", rows)
    narrow = laps.select(*K.SESSION, "LapTime")
    quartiles = quantiles(narrow, K.SESSION, "LapTime", {"_q1": 0.25, "_q3": 0.75}, large)
    fences = written_table(filters.iqr_fences(quartiles, factor), "fences")
    inside = narrow.join(fences, K.SESSION).where(F.col("LapTime").between(F.col("_low"), F.col("_high")))
    if large is None:
        return inside.groupBy(*K.SESSION).agg(
            F.first("_low").alias("_low"), F.first("_high").alias("_high"),
            F.percentile("LapTime", 0.5).alias("session_baseline"))
    return fences.join(quantiles(inside, K.SESSION, "LapTime", {"session_baseline": 0.5}, large), K.SESSION)


def surviving_laps(laps: DataFrame) -> DataFrame:
    """Laps inside the outlier fences of their session, with the session median and the residual against it.

    The session statistics are written out first, so the rows themselves only meet a small broadcast table.
    """
    statistics = written_table(session_statistics(laps), "session-statistics")
    return (
        laps.join(statistics, K.SESSION)
        .where(F.col("LapTime").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
        .withColumn("LapTimeResidual", F.col("LapTime") - F.col("session_baseline"))
    )


def session_baseline(laps: DataFrame, *, rows: int = SMALL_GROUP) -> DataFrame:
    """Attach the session median and the residual against it."""
    medians = written_table(group_quantiles(laps, K.SESSION, "LapTime", {"session_baseline": 0.5}, rows=rows), "session-medians")
    return laps.join(medians, K.SESSION, "left").withColumn(
        "LapTimeResidual", F.col("LapTime") - F.col("session_baseline")
    )


def build_features(
    laps: DataFrame, session: str = "R", *, version: str = "v4", max_residual: float | None = None,
    excluded: Sequence[str] = K.EXCLUDED_GPS, eras: Mapping[int, int] = K.REGULATION_ERAS,
    form_order: str = "gp", segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Features of one session type. ``version`` "v3" leaves out era, race control, weather and form."""
    if version not in ("v3", "v4"):
        raise ValueError(f"unknown feature version {version!r}")
    limit = K.MAX_RESIDUAL.get(session, K.MAX_RESIDUAL["R"]) if max_residual is None else max_residual
    v4 = version == "v4"

    base = filters.session_is(filters.basic_filter(laps, excluded=excluded), session)
    kept = surviving_laps(base).withColumn("CompoundEncoded", S.compound_code("Compound"))
    if v4:
        kept = kept.withColumns({c: F.lit(0) for c in ("is_sc", "is_vsc", "is_yellow") if c not in kept.columns})
        kept = kept.withColumns({
            "is_neutralized": S.is_neutralized(), "regulation_era": S.regulation_era("year", eras),
        })
        if {"AirTemp", "TrackTemp"} <= set(kept.columns):
            kept = kept.withColumn("temp_delta", F.col("TrackTemp") - F.col("AirTemp"))

    s = open_segments(
        kept, K.LAP_GROUP, [K.LAP_ORDER], rows=segment_rows, depth=history.LOOKBACK, maxima=["TyreLife"],
        within="Stint", marks={"neutralized": F.col("is_neutralized") == 1} if v4 else None,
        census=base,
    )
    telemetry = [c for c in K.TELEMETRY_COLUMNS if c in kept.columns]
    columns = history.lap_time_columns(s) | history.telemetry_columns(s, telemetry) | history.tyre_columns(s)
    columns |= {"_driver_laps": F.max("LapNumber").over(s.whole())} if not v4 else {"_position": s.position()}
    built = s.frame.withColumns(columns)
    if v4:
        built = built.withColumns(history.neutralization_columns(s, F.col("is_neutralized")))
    built = history.derived_scores(s.close(built.withColumns(history.stint_columns(s))))

    if v4:
        races = written_table(kept.groupBy("year", "gp", "session_code", "Driver").agg(
            F.avg("LapTimeResidual").alias("mean_residual"), F.max("LapNumber").alias("_laps"),
            *([F.max(form_order).alias(form_order)] if form_order != "gp" else []),
        ), "races")
        lengths = races.groupBy(*K.SESSION).agg(F.max("_laps").alias("_race_laps"))
        form = recent_form(races.where(F.col("Driver").isNotNull()), order=form_order).select(
            "Driver", "year", "gp", "avg_residual_last_3_races"
        )
        built = built.drop("_position").join(lengths, K.SESSION, "left").join(form, ["Driver", "year", "gp"], "left")
    else:
        built = built.withColumnRenamed("_driver_laps", "_race_laps")
    built = (
        built.withColumn("LapNumber_pct", F.try_divide(F.col("LapNumber"), F.col("_race_laps"))).drop("_race_laps")
        .withColumns({
            "tyre_x_progress": F.col("TyreLife") * F.col("LapNumber_pct"),
            "compound_x_tyre": F.col("CompoundEncoded") * F.col("TyreLife"),
        })
    )
    return filters.residual_filter(built, limit).where(F.col("LapTimeResidual").isNotNull())

"""Joins: nearest reading in time, per-lap race-control flags, qualifying, encodings, routing, fastest lap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions import scalars as S
from lapforge.operators.segments import EXTRA, SEGMENT_ROWS, open_segments

LAP_RUN = 1000
WEATHER_VALUES = ["AirTemp", "TrackTemp", "Humidity", "Pressure", "Rainfall", "WindSpeed", "WindDirection"]


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], right_order: str | None = None, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Attach ``values`` of the ``right`` row nearest in time, either direction, without tolerance.

    The earlier row wins a tie; of rows with one time the first (by ``right_order``) counts. Both sides go through
    one shuffle as a single time-ordered stream per key: the last reading so far and the next reading to come are the
    only candidates. Left rows without a time, or in a group without readings, get NULLs.
    """
    keys, values = list(keys), list(values)
    first_of = F.struct(*[F.col(c) for c in ([right_order] if right_order else values)])
    readings = (
        right.where(F.col(right_time).isNotNull())
        .groupBy(*keys, F.col(right_time).alias("_time"))
        .agg(F.min_by(F.struct(*values), first_of).alias("_reading"))
    )
    reading_type = dict(readings.dtypes)["_reading"]
    payload = F.struct(*left.columns)
    payload_type = dict(left.select(payload.alias("p")).dtypes)["p"]
    timed = left.where(F.col(left_time).isNotNull()).select(
        *keys, F.unix_micros(left_time).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(f"struct<at:bigint,v:{reading_type}>").alias("_seen"), payload.alias("_left"),
    )
    at = F.unix_micros("_time")
    seen = readings.select(
        *keys, at.alias("_at"), F.lit(0).alias("_side"),
        F.struct(at.alias("at"), F.col("_reading").alias("v")).alias("_seen"),
        F.lit(None).cast(payload_type).alias("_left"),
    )
    s = open_segments(
        timed.unionByName(seen), keys, ["_at", "_side"], rows=rows,
        lasts={"back": F.col("_seen")}, nexts={"ahead": F.col("_seen")},
    )
    back = F.coalesce(F.last("_seen", ignorenulls=True).over(s.running()), s.carried("back"))
    ahead = F.coalesce(F.last("_seen", ignorenulls=True).over(s.backwards()), s.carried("ahead"))
    matched = s.close(s.frame.withColumns({"_back": back, "_ahead": ahead})).where(F.col("_side") == 1)
    forward_wins = F.col("_back").isNull() | (F.col("_ahead.at") - F.col("_at") < F.col("_at") - F.col("_back.at"))
    chosen = F.when(F.col("_ahead").isNotNull() & forward_wins, F.col("_ahead")).otherwise(F.col("_back"))
    found = matched.select(F.col("_left"), chosen.alias("_chosen")).select(
        *[F.col(f"_left.{c}") for c in left.columns], *[F.col(f"_chosen.v.{v}").alias(v) for v in values]
    )
    kinds = dict(right.select(*values).dtypes)
    untimed = left.where(F.col(left_time).isNull()).select(
        *left.columns, *[F.lit(None).cast(kinds[v]).alias(v) for v in values]
    )
    return found.unionByName(untimed)


def attach_weather(
    laps: DataFrame, weather: DataFrame, *, keys: Sequence[str], start: str = "LapStartTime", time: str = "Time",
    order: str | None = None, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Weather at the start of a lap. A reading without rain information counts as rain."""
    rain = F.coalesce(F.col("Rainfall").cast("boolean"), F.lit(True)).cast("double")
    ready = weather.withColumn("Rainfall", rain)
    values = [v for v in WEATHER_VALUES if v in weather.columns]
    return nearest_in_time(laps, ready, keys=keys, left_time=start, right_time=time, values=values,
                           right_order=order, rows=rows)


def lap_flags(
    messages: DataFrame, *, keys: Sequence[str], order: Sequence[str], lap: str = "Lap",
    carry_forward: bool = False, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Per (keys, lap): ``is_sc``, ``is_vsc``, ``is_yellow`` from the running state of race-control messages.

    Messages without a lap are ignored. Only laps with a message get a row; ``carry_forward`` instead reports the
    state for every lap between the first and the last message of the group.
    """
    keys = list(keys)
    known = messages.where(F.col(lap).isNotNull()).withColumns(S.neutralization_change("Category", "Status", "Message"))
    known = known.withColumn("_at", F.unix_micros(order[0]) if dict(messages.dtypes)[order[0]].startswith("timestamp")
                             else F.col(order[0]))
    states = ["sc", "vsc"]
    s = open_segments(known, keys, ["_at", *order[1:]], rows=rows, lasts={n: F.col(n) for n in states})

    def active(name: str) -> Column:
        seen = F.coalesce(F.last(name, ignorenulls=True).over(s.running()), s.carried(name))
        return F.coalesce(seen, F.lit(0)).cast("int")

    running = s.close(s.frame.withColumns({f"_{n}": active(n) for n in states}))
    per_lap = running.groupBy(*keys, lap).agg(
        F.max("_sc").alias("is_sc"), F.max("_vsc").alias("is_vsc"), F.max(S.is_yellow("Message")).alias("is_yellow"),
        F.max_by(F.struct("_sc", "_vsc"), F.struct("_at", *order[1:])).alias("_after"),
    )
    if not carry_forward:
        return per_lap.drop("_after")
    upto = F.coalesce(F.lead(lap).over(Window.partitionBy(*keys).orderBy(lap)) - 1, F.col(lap))
    # In two steps, so that even an absurd lap number makes no gigantic array.
    runs = per_lap.withColumn("_upto", upto).withColumn("_from", F.explode(F.sequence(F.col(lap), F.col("_upto"), F.lit(LAP_RUN))))
    spread = runs.withColumn("_lap", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + LAP_RUN - 1, F.col("_upto")))))
    same = F.col("_lap") == F.col(lap)
    return spread.select(
        *keys, F.col("_lap").cast(dict(messages.dtypes)[lap]).alias(lap),
        F.when(same, F.col("is_sc")).otherwise(F.col("_after._sc")).alias("is_sc"),
        F.when(same, F.col("is_vsc")).otherwise(F.col("_after._vsc")).alias("is_vsc"),
        F.when(same, F.col("is_yellow")).otherwise(F.lit(0)).alias("is_yellow"),
    )


def attach_flags(laps: DataFrame, flags: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of per-lap flags; laps without any get zeros."""
    names = [c for c in flags.columns if c not in on]
    return laps.join(flags, list(on), "left").na.fill(0, names)


def quali_results(results: DataFrame, *, event: Sequence[str] = ("year", "round")) -> DataFrame:
    """Qualifying and grid position (the same number) and the gap to the fastest driver of the event in ms."""
    event = list(event)
    timed = results.withColumn("_best_ms", S.best_quali_time("Q3", "Q2", "Q1") * 1000)
    poles = timed.groupBy(*event).agg(F.min("_best_ms").alias("_pole_ms"))
    position = S.integer_or("position")
    return timed.join(poles, event, "left").select(
        *event, "Driver", position.alias("quali_position"), position.alias("grid_position"),
        (F.col("_best_ms") - F.col("_pole_ms")).alias("gap_to_pole_ms"),
    )


def attach_quali(laps: DataFrame, results: DataFrame, *, event: Sequence[str] = ("year", "round")) -> DataFrame:
    """Qualifying columns on race laps; other sessions keep NULLs."""
    on = [*event, "Driver"]
    races = results.withColumn("session_code", F.lit("R"))
    return laps.join(races, [*on, "session_code"], "left")


def route_predictions(
    scored: DataFrame, local: DataFrame, *, gp: str = "gp", row_id: Sequence[str], global_column: str = "pred_global",
    local_column: str = "pred_local",
) -> DataFrame:
    """Prefer the prediction of the track's own model; ``model_used`` tells which one answered."""
    tracks = local.select(F.col("slug").alias("_slug"), *[F.col(c) for c in row_id], F.col(local_column))
    joined = scored.withColumn("slug", S.slug(gp)).join(
        tracks, [F.col("slug") == F.col("_slug"), *[scored[c] == tracks[c] for c in row_id]], "left"
    )
    return joined.select(
        *[scored[c] for c in scored.columns], "slug",
        F.coalesce(F.col(local_column), F.col(global_column)).alias("prediction"),
        F.when(F.col(local_column).isNotNull(), "local").otherwise("global").alias("model_used"),
    )


def fastest_lap_trace(
    laps: DataFrame, samples: DataFrame, *, session: Sequence[str], lap_key: Sequence[str], time: str = "LapTime",
    ordered_by: str = "ts",
) -> DataFrame:
    """Position samples of the fastest lap of each session; ties go to the smallest lap key."""
    best = laps.where(F.col(time).isNotNull()).groupBy(*session).agg(
        F.min_by(F.struct(*lap_key), F.struct(time, *lap_key)).alias("_lap")
    ).select(*session, *[F.col(f"_lap.{k}").alias(k) for k in lap_key])
    return samples.join(best, [*session, *lap_key], "left_semi").select(*session, *lap_key, ordered_by, "X", "Y")

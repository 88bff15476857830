"""Ingest: which sessions to load, what was loaded, and raw tables -> lap rows in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions import scalars as S
from lapforge.operators import aggregates, joins
from lapforge.operators.segments import SEGMENT_ROWS
from lapforge.operators.splits import latest_per_key
from lapforge.session import written_table
from lapforge.sources import batches


def load_schedule(raw: DataFrame, year: str = "year") -> DataFrame:
    """Event name and numeric round; text that is no number becomes NULL."""
    return raw.select(year, "EventName", S.numeric("RoundNumber").cast("int").alias("RoundNumber"))


def session_plan(
    spark: SparkSession, schedule: DataFrame, *, years: Sequence[int] = K.INGEST_YEARS,
    sessions: Sequence[str] = K.INGEST_SESSIONS,
) -> DataFrame:
    """Every (year, event, session type) to load; testing events (round 0 or unknown) are left out."""
    codes = F.explode(F.array(*[F.lit(s) for s in sessions])).alias("session_code")
    return (
        schedule.where(F.col("year").isin(list(years)) & (F.col("RoundNumber") != 0))
        .select("year", F.col("EventName").alias("gp"), F.col("RoundNumber").alias("round"), codes)
        .withColumn("key", S.session_key())
    )


def pending(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sessions that were never completed; an earlier failure does not exclude one."""
    done = outcomes.where(F.col("status") == "completed").select("key")
    return plan.join(done, "key", "left_anti")


def outcome(plan: DataFrame, laps: DataFrame) -> DataFrame:
    """``completed`` for sessions that yielded laps, ``failed`` for the rest."""
    counts = laps.groupBy(S.session_key().alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    return plan.select("key").join(counts, "key", "left").select(
        "key", F.when(n > 0, "completed").otherwise("failed").alias("status"), n.alias("n_rows")
    )


def latest_outcomes(log: DataFrame) -> DataFrame:
    return latest_per_key(log, ["key"], ["seq"])


def run_batch(
    spark: SparkSession, path: str, batch: str, sessions: DataFrame, load: Callable[[DataFrame], DataFrame],
    before_commit: Callable[[], None] | None = None,
) -> None:
    """Load the batch's ``sessions`` that no other batch has completed, and commit laps and outcomes together.

    After a crash the same call does what is left to do; after a commit it replaces the batch by its newest laps.
    """
    todo = written_table(pending(sessions, batches.committed_outcomes(spark, path, but=batch)), "todo")
    laps = written_table(load(todo), "loaded")
    logged = outcome(todo, laps).withColumn("seq", F.lit(0).cast("bigint"))
    batches.commit(spark, path, batch, laps, logged.select("key", "status", "n_rows", "seq"), before_commit)


def lap_rows(laps: DataFrame) -> DataFrame:
    """Types and defaults of raw laps: -1 for unknown numbers, False for unknown flags, seconds for durations."""
    duration = dict(laps.dtypes)["LapTime"].startswith("interval")
    out = {
        "LapNumber": S.integer_or("LapNumber"), "DriverNumber": S.integer_or("DriverNumber"),
        "Stint": S.numeric("Stint"), "TyreLife": S.numeric("TyreLife"), "Position": S.numeric("Position"),
        "LapTime": S.seconds("LapTime") if duration else S.numeric("LapTime"),
        "Deleted": S.flag_or("Deleted") if "Deleted" in laps.columns else F.lit(False),
        "TrackStatus": F.coalesce(F.col("TrackStatus"), F.lit("1")) if "TrackStatus" in laps.columns else F.lit("1"),
    }
    return laps.withColumns({name: c for name, c in out.items() if name in laps.columns or name == "Deleted"})


def assemble(
    laps: DataFrame, samples: DataFrame, weather: DataFrame, messages: DataFrame, quali: DataFrame | None = None, *,
    session: Sequence[str], lap_key: Sequence[str], message_order: Sequence[str], min_samples: int = K.MIN_SAMPLES,
    event: Sequence[str] = ("year", "round"), rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Raw tables -> laps. A lap without enough samples is left out.

    Samples collapse to one row per lap before anything is joined, so the widest table moves once, already small.
    """
    session = list(session)
    telemetry = aggregates.lap_telemetry(samples, [*session, *lap_key], min_samples=min_samples)
    known = laps.join(telemetry, [*session, *lap_key])
    dressed = joins.attach_weather(known, weather, keys=session, rows=rows)
    flags = joins.lap_flags(messages, keys=session, order=message_order, rows=rows)
    dressed = joins.attach_flags(dressed, flags.withColumnRenamed("Lap", "LapNumber"), [*session, "LapNumber"])
    if quali is not None:
        dressed = joins.attach_quali(dressed, joins.quali_results(quali, event=event), event=event)
    return dressed

"""Live features on Structured Streaming, with their state in Spark's state store.

The polling loop becomes a windowed aggregate over short stretches of event time, *panes*. A pane of a key holds sums, and its
samples' lap times in time order, so a sample that comes late finds its true neighbours. A watermark closes panes: what comes
for a closed pane is dropped, and its state is given up, so the state holds the panes of the last ``delay`` and no more. Every
batch hands the panes it changed to a keyed sink; the newest version of each counts. Features of any longer stretch (a
session, a day) are put together from panes, with the changes between the last sample of one and the first of the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapforge import schemas
from lapforge.operators import aggregates
from lapforge.operators.segments import SEGMENT_ROWS, open_segments
from lapforge.operators.splits import latest_per_key
from lapforge.session import written_table

PANE = "_pane"


def event_stream(spark: SparkSession, path: str, schema: str = schemas.EVENTS, **options) -> DataFrame:
    """A file stream with an explicit schema and an event time that watermarks accept."""
    raw = spark.readStream.schema(schema).options(**options).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain_panes(
    samples: DataFrame, keys: Sequence[str], path: str, checkpoint: str, *, delay: str, pane: str,
    time: str = "ts", order: Sequence[str] = ("ts", "event_id"),
) -> StreamingQuery:
    """Bring the panes under ``path`` up to date with all that the stream ``samples`` has, then stop.

    A sample is late by up to ``delay`` behind the newest one of earlier batches, or its pane may be closed and the sample
    is dropped. Samples without a time belong to no pane. A repeated batch writes the same folder again; a new start goes
    on from ``checkpoint``. The state of a pane grows with its own samples only: choose ``pane`` so that those of a key fit
    a task.
    """
    parts = samples.withWatermark(time, delay).groupBy(F.window(time, pane).alias(PANE), *keys).agg(*aggregates.live_pane_parts(order))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn(PANE, F.col(f"{PANE}.start")).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    query = parts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def features_of_panes(
    spark: SparkSession, path: str, keys: Sequence[str], *, window: str | None = None, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The live features of every key: of all its panes, or, with the name of a date part, of each such ``window_start``.

    The newest version of each pane is written as a side table first, as it is read more than once.
    """
    panes = written_table(latest_per_key(spark.read.parquet(path), [PANE, *keys], ["_batch"]), "panes")
    if window:
        panes, keys = panes.withColumn("window_start", F.date_trunc(window, PANE)), [*keys, "window_start"]
    return aggregates.join_live_panes(panes, keys, PANE, rows=rows)


def drain_scores(samples: DataFrame, keys: Sequence[str], model, path: str, checkpoint: str) -> StreamingQuery:
    """Score the features of every key that changed with a fitted ``PipelineModel``, as part of the streaming plan.

    The state is one row of sums for each key. ``features_of_panes`` is the way where features follow the order of samples.
    """
    features = samples.groupBy(*keys).agg(*aggregates.live_aggregates())

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    query = model.transform(features).writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

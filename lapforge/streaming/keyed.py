"""Previous-lap features with the state of every driver in Spark's state store.

A lap is held back until the watermark has passed its time, so that laps which come late, by up to the watermark's delay,
still stand in their place. Then a timer releases it, in order, with the history of the five laps released before it. State
of a driver: the laps not yet released, and the last five that were. Laps later than the delay are dropped by the watermark
and counted in the query's progress. A driver without laps for ``forget`` of event time is forgotten.

Unlike ``streaming.history``, which corrects laps that have been answered and may read all stored laps to do so, this answers
every lap once and never looks back further than its state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lapforge.operators.history import LOOKBACK
from lapforge.streaming.history import FEATURES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state holds laps in blocks, one for each batch of rows that Python gets: an element for every lap would cross to the JVM alone.
BLOCK = "laps binary"
LAP = np.dtype([("at", "<i8"), ("lap", "<i8"), ("value", "<f8")])
#: Rows reach Python as named tuples, which take no name that begins with an underscore.
AT = "event_ms"


def history_columns(values: np.ndarray, known: int) -> dict[str, np.ndarray]:
    """The history of each of ``values`` after the first ``known``, from the values before it; NaN is missing."""
    padded = np.concatenate([np.full(LOOKBACK, np.nan), values])
    before = np.lib.stride_tricks.sliding_window_view(padded, LOOKBACK)[known:len(values)]
    three, there = before[:, -3:], ~np.isnan(before)
    n3, n5 = there[:, -3:].sum(axis=1), there.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean5 = np.nansum(before, axis=1) / n5
        spread = np.sqrt(np.nansum((before - mean5[:, None]) ** 2, axis=1) / (n5 - 1))
        return dict(zip(FEATURES, (
            before[:, -1], np.where(n3 > 0, np.nansum(three, axis=1) / n3, np.nan),
            before[:, -1] - before[:, -2], np.where(n5 > 1, spread, np.nan)), strict=True))


def _laps(state) -> np.ndarray:
    blocks = [np.frombuffer(block, LAP) for (block,) in state.get()] if state.exists() else []
    return np.concatenate([np.empty(0, LAP), *blocks])


class LapHistory(StatefulProcessor):
    """List states of pending and recent laps, in blocks; event-time timers that release laps and forget drivers."""

    def __init__(self, keys: Sequence[str], order: str, value: str, forget_ms: int):
        self.keys, self.order, self.value, self.forget_ms = list(keys), order, value, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", BLOCK)
        self.recent = handle.getListState("recent", BLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            laps = np.empty(len(batch), LAP)
            laps["at"], laps["lap"], laps["value"] = batch[AT], batch[self.order], batch[self.value]
            if len(laps):
                self.pending.appendValue((laps.tobytes(),))
                first = min(int(laps["at"].min()), first if first is not None else 1 << 62)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pending, recent = _laps(self.pending), _laps(self.recent)
        passed = pending["at"] <= now
        due, rest = pending[passed][::-1], pending[~passed]
        due = due[np.unique(due["lap"], return_index=True)[1]]  # of equal laps the one that came last
        due = due[np.lexsort((due["lap"], due["at"]))]
        if not len(due):
            if not len(rest) and len(recent) and int(recent["at"][-1]) + self.forget_ms <= now:
                self.recent.clear()
            return
        chain = np.concatenate([recent, due])
        self.recent.put([(chain[-LOOKBACK:].tobytes(),)])
        if len(rest):
            self.pending.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest["at"].min()))
        else:
            self.pending.clear()
            self.handle.registerTimer(int(chain["at"][-1]) + self.forget_ms)
        out = pd.DataFrame({**{k: [v] * len(due) for k, v in zip(self.keys, key, strict=True)}, self.order: due["lap"],
                            self.value: due["value"], **history_columns(chain["value"], len(recent))})
        yield out

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """Keyed state needs the RocksDB provider; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain_history(
    laps: DataFrame, keys: Sequence[str], path: str, checkpoint: str, *, time: str, delay: str, forget_ms: int,
    order: str = "LapNumber", value: str = "LapTime",
) -> StreamingQuery:
    """Release under ``path`` all laps that the watermark has passed, then stop; a new start goes on from ``checkpoint``.

    ``time`` is the time of a lap, growing with ``order`` for each key. The watermark follows the newest lap of any key: a
    feed that ends should end with a record of a later time, under a key of its own, whose laps nobody reads. Of two laps
    with equal order in one release one is kept.
    """
    keys, spark = list(keys), laps.sparkSession
    kinds = dict(laps.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{order}` bigint", f"`{value}` double", *[f"{n} double" for n in FEATURES]])
    read = laps.withWatermark(time, delay).select(*keys, F.col(order).cast("bigint").alias(order), F.col(value).cast("double").alias(value),
                                                  F.unix_millis(time).alias(AT), time)
    with rocks_state(spark):
        released = read.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=LapHistory(keys, order, value, forget_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
        query = released.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query

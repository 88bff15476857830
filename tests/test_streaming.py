from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.operators import aggregates, history
from lapforge.operators.splits import latest_per_key
from lapforge.plans import stages, training
from lapforge.sources import testdata
from lapforge.streaming import history as stream_history
from lapforge.streaming import ingest, keyed, live
from helpers import season, sorted_rows

SF = "/root/testdata/sf0.001"


def split_files(df, path, column, cuts):
    """Write ``df`` as one file per range of ``column``, oldest first."""
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        df.where((F.col(column) >= low) & (F.col(column) < high)).coalesce(1).write.mode("append").parquet(path)


KEYS = ["session", "driver"]
ORDER = ["ts", "event_id"]


def drained(spark, tmp_path, events, slots, *, delay="1000 days", pane="1 day", keys=KEYS):
    """Drain the slots of a feed one after the other, each in a query of its own; the progress of all batches."""
    progress = []
    for slot in slots:
        events.where(slot).write.mode("append").parquet(str(tmp_path / "in"))
        stream = testdata.as_samples(live.event_stream(spark, str(tmp_path / "in")))
        query = live.drain_panes(stream, keys, str(tmp_path / "out"), str(tmp_path / "state"), delay=delay, pane=pane)
        progress += query.recentProgress
    return progress


def check_live(got, expected, keys):
    a, b = (sorted_rows(d, *keys) for d in (got, expected))
    assert len(a) == len(b) > 0 and set(a.columns) == set(b.columns) and a["lap_time_delta"].notna().any()
    for c in b.columns:
        kind = float if a[c].dtype.kind != "M" else "int64"
        np.testing.assert_allclose(a[c].astype(kind), b[c].astype(kind), atol=1e-9)


@pytest.mark.parametrize("slots", [
    ["dayofmonth(ts) < 5", "dayofmonth(ts) BETWEEN 5 AND 11", "dayofmonth(ts) > 11"],
    ["event_id % 2 = 1", "event_id % 2 = 0"],  # late samples part neighbours of the first batch
    [f"pmod(xxhash64(event_id), 3) = {i}" for i in (2, 0, 1)],
])
def test_stream_equals_batch_whatever_the_order(spark, tmp_path, slots):
    drained(spark, tmp_path, testdata.table(spark, SF, "events"), slots)
    out = live.features_of_panes(spark, str(tmp_path / "out"), KEYS, rows=5)
    check_live(out, aggregates.live_features(testdata.telemetry_samples(spark, SF), KEYS, order=ORDER), KEYS)


def test_late_sample_changes_its_neighbours(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, "view", float(16 * i * i % 77), f'{{"k": {5 * i}}}') for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    drained(spark, tmp_path, events, ["event_id % 2 = 1", "event_id % 2 = 0"], pane="5 minutes")
    out = live.features_of_panes(spark, str(tmp_path / "out"), KEYS).first()
    times = [80 + (16 * i * i % 77) // 1 / 16 for i in range(20)]
    assert out.lap_time_delta == pytest.approx(np.diff(times).mean())


def test_too_late_samples_are_dropped_and_state_stays_small(spark, tmp_path):
    events = testdata.table(spark, SF, "events").where(F.dayofmonth("ts") <= 11)
    day = F.dayofmonth("ts")
    times = sorted(r.d for r in events.select(day.alias("d")).distinct().collect())
    late = F.col("event_id") % 7 == 3
    slots = [((day == d) & ~late) | ((day == d - 1) & late & (F.hour("ts") >= 12)) | ((day == d - 4) & late & (F.hour("ts") < 12)) for d in times]
    progress = drained(spark, tmp_path, events, slots, delay="1 day", pane="1 hour", keys=["session"])
    # a day's late samples of the afternoon come a day late and count, those of the morning come four days late
    expected = events.where(~late | ((F.hour("ts") >= 12) & (day < max(times))))
    got = live.features_of_panes(spark, str(tmp_path / "out"), ["session"])
    check_live(got, aggregates.live_features(testdata.as_samples(expected.withColumn("ts", F.col("ts").cast("timestamp"))), ["session"], order=ORDER), ["session"])
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    panes = spark.read.parquet(str(tmp_path / "out")).select("_pane", "session").distinct().count()
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) > 0
    assert len(times) > 10 and max(held) <= 3 * 24 * 10 and max(held) < panes / 2


def test_repeated_batch_and_restart_change_nothing(spark, tmp_path):
    events = testdata.table(spark, SF, "events")
    drained(spark, tmp_path, events, ["event_id % 2 = 1", "event_id % 2 = 0", "false"])
    out = live.features_of_panes(spark, str(tmp_path / "out"), KEYS)
    check_live(out, aggregates.live_features(testdata.telemetry_samples(spark, SF), KEYS, order=ORDER), KEYS)


@pytest.mark.parametrize("width", [8, 20])
def test_keyed_history_orders_late_laps(spark, tmp_path, width):
    raw = season(4, ("A", "B"), (2024,), 40)
    raw.loc[raw.index % 11 == 3, "LapTime"] = np.nan
    df = spark.createDataFrame(raw).withColumn("LapTime", F.when(~F.isnan("LapTime"), F.col("LapTime")))
    df = df.select(*K.LAP_GROUP, "LapNumber", "LapTime").withColumn("finished", F.timestamp_seconds(F.col("LapNumber") * 60))
    slot = F.expr(f"(LapNumber - 1) div {width}") + F.pmod(F.xxhash64("DriverNumber", "gp", "LapNumber"), F.lit(2))
    slots, held, dropped = 40 // width + 1, [], 0
    end = df.limit(1).withColumns({"DriverNumber": F.lit(-1).cast("bigint"), "finished": F.lit("2100-01-01").cast("timestamp")})
    for i in range(slots):
        part = df.where(slot == i)
        (part.unionByName(end) if i == slots - 1 else part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = keyed.drain_history(stream, K.LAP_GROUP, str(tmp_path / "out"), str(tmp_path / "state"), time="finished",
                                    delay=f"{width} minutes", forget_ms=1 << 50)
        operators = [p.stateOperators[0] for p in query.recentProgress]
        dropped += sum(o.numRowsDroppedByWatermark for o in operators)
        pending = spark.read.format("statestore").options(path=str(tmp_path / "state"), stateVarName="pending").load()
        held.append(pending.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
    check_history(spark.read.parquet(str(tmp_path / "out")).where("DriverNumber >= 0"), df)
    # a lap is at most one slot late, so two slots of laps wait, however long the race
    assert dropped == 0 and max(held) <= 2 * width


def test_history_columns_of_values():
    values = np.array([1.0, np.nan, 4.0, 2.0, 8.0, np.nan, 5.0])
    got = keyed.history_columns(values, 2)
    np.testing.assert_allclose(got["lap_time_prev"], [np.nan, 4, 2, 8, np.nan])
    np.testing.assert_allclose(got["lap_time_mean_3_prev"], [1, 2.5, 3, 14 / 3, 5])
    np.testing.assert_allclose(got["lap_time_delta_prev"], [np.nan, np.nan, -2, 6, np.nan])
    np.testing.assert_allclose(got["lap_time_std_5_prev"][1:4], [np.std([1, 4], ddof=1), np.std([1, 4, 2], ddof=1), np.std([1, 4, 2, 8], ddof=1)])


def lap_files(spark, tmp_path):
    raw = season(3, ("A", "B"), (2024,), 23)
    raw.loc[raw.index % 11 == 3, "LapTime"] = np.nan
    df = spark.createDataFrame(raw).withColumn("LapTime", F.when(~F.isnan("LapTime"), F.col("LapTime")))
    path = str(tmp_path / "laps")
    split_files(df, path, "LapNumber", [0, 4, 5, 11, 100])
    return df, path


def check_history(out, df):
    keys = [*K.LAP_GROUP, "LapNumber"]
    a, b = sorted_rows(out, *keys), sorted_rows(history.lap_time_history(df), *keys)
    assert len(a) == len(b)
    for c in stream_history.FEATURES:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_laps_correct_the_laps_behind_them(spark, tmp_path, seed):
    df, _ = lap_files(spark, tmp_path)
    path = str(tmp_path / "shuffled")
    split_files(df.withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), *K.LAP_GROUP, "LapNumber"), F.lit(4))), path, "_f", [0, 1, 2, 3, 4])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    check_history(stream_history.history_in_batches(stream, K.LAP_GROUP, str(tmp_path / "o"), str(tmp_path / "s")), df)


def test_batchwise_history_with_stored_laps(spark, tmp_path):
    df, path = lap_files(spark, tmp_path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = stream_history.history_in_batches(stream, K.LAP_GROUP, str(tmp_path / "out"), str(tmp_path / "state"), rows=4)
    check_history(out, df)


@pytest.mark.parametrize("estimator", ["linear", "booster"])
def test_live_scores_with_a_saved_pipeline(spark, tmp_path, estimator):
    features = aggregates.live_features(testdata.telemetry_samples(spark, SF), KEYS, order=ORDER).where("lap_time_mean_3 IS NOT NULL")
    model = None if estimator == "linear" else training.booster({"n_estimators": 2, "max_depth": 2}, label="lap_time_mean_3")
    pipeline = stages.encoded_regression(["speed_mean", "rpm_mean"], ["session"], target="lap_time_mean_3", estimator=model)
    fitted = pipeline.fit(features)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = stages.load_pipeline(spark, str(tmp_path / "model"))
    for part in ("event_id % 3 = 0", "event_id % 3 > 0"):
        testdata.table(spark, SF, "events").where(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = testdata.as_samples(live.event_stream(spark, str(tmp_path / "in")))
        live.drain_scores(stream, KEYS, loaded, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted_rows(latest_per_key(spark.read.parquet(str(tmp_path / "out")), KEYS, ["_batch"]).select(*KEYS, "prediction"), *KEYS)
    everything = aggregates.live_features(testdata.telemetry_samples(spark, SF), KEYS, order=ORDER)
    expected = sorted_rows(fitted.transform(everything).select(*KEYS, "prediction"), *KEYS)
    assert len(got) == len(expected) > 0
    np.testing.assert_allclose(got["prediction"], expected["prediction"], atol=1e-9)


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame(season(2, ("A", "B", "C"), (2024,), 5)).select("year", "gp", "session_code", "DriverNumber", "LapNumber")
    source, target, log, state = (str(tmp_path / n) for n in ("in", "laps", "log", "state"))
    df.where("gp = 'A'").coalesce(1).write.parquet(source)
    ingest.ingest_new_files(spark, source, df.schema, target, log, state)
    ingest.ingest_new_files(spark, source, df.schema, target, log, state)
    assert spark.read.parquet(target).count() == 10
    df.where("gp <> 'A'").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_new_files(spark, source, df.schema, target, log, state)
    assert spark.read.parquet(target).count() == 30
    assert {r.key for r in spark.read.parquet(log).collect()} == {"2024|A|R", "2024|B|R", "2024|C|R"}
    plan = spark.createDataFrame([("2024|A|R",), ("2024|D|R",)], "key string")
    ingest.ingest_new_files(spark, source, df.schema, target, log, state, plan)
    failed = spark.read.parquet(log).where("status = 'failed'").collect()
    assert [(r.key, r.n_rows) for r in failed] == [("2024|D|R", 0)]


class OneDriver:
    """The state handle of one driver, in memory."""

    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        return self.lists.setdefault(name, ListOfOne())

    def registerTimer(self, at):
        self.timers.append(at)


class ListOfOne:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


def test_keyed_state_holds_blocks_of_laps():
    handle, processor = OneDriver(), keyed.LapHistory(["driver"], "LapNumber", "LapTime", 1000)
    processor.init(handle)
    laps = pd.DataFrame({"driver": 1, keyed.AT: range(40, 0, -1), "LapNumber": range(40, 0, -1), "LapTime": np.arange(40.0)})
    laps.loc[5, "LapTime"] = np.nan
    again = laps[laps.LapNumber == 7].assign(LapTime=99.0)
    processor.handleInputRows((1,), iter([laps, again]), None)
    assert len(handle.lists["pending"].rows) == 2 and min(handle.timers) == 1
    out = []
    for now in (30, 100):
        out += processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None)
    assert [len(o) for o in out] == [30, 10] and not handle.lists["pending"].exists() and len(handle.lists["recent"].rows) == 1
    found, values = pd.concat(out), np.where(np.arange(40) == 6, 99.0, laps["LapTime"].to_numpy()[::-1])
    assert found["LapNumber"].tolist() == list(range(1, 41)) and np.array_equal(found["LapTime"], values, equal_nan=True)
    for name, expected in keyed.history_columns(values, 0).items():
        assert np.allclose(found[name], expected, equal_nan=True)
    assert not list(processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1040), None))
    assert not handle.lists["recent"].exists()


def test_last_laps_of_a_driver_are_those_that_came_last(spark, tmp_path):
    """A lap that comes again replaces the stored one, in the answer and in what later batches see of it."""
    df = spark.createDataFrame(season(1, ("A",), (2023,), 9)).select(*K.LAP_GROUP, K.LAP_ORDER, "LapTime")
    feed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (df.where("LapNumber <= 6"), df.where("LapNumber = 6").withColumn("LapTime", F.lit(500.0)), df.where("LapNumber > 6")):
        part.coalesce(1).write.mode("append").parquet(feed)
        got = stream_history.history_in_batches(spark.readStream.schema(df.schema).parquet(feed), K.LAP_GROUP, out, state)
    tails = spark.read.parquet(f"{state}/tails/1")
    assert {r.LapTime for r in tails.where("LapNumber = 6").collect()} == {500.0} and tails.count() == 5
    assert got.where("LapNumber = 7").first().lap_time_prev == 500.0

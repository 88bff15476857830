import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lapforge import schemas
from lapforge.operators import joins
from lapforge.plans import ingest
from lapforge.session import shared_dir
from lapforge.sources import tables
from lapforge.sources import testdata


def test_csv_reads_nan_as_null(spark, tmp_path):
    path = tmp_path / "laps.csv"
    path.write_text("gp,LapTime\nA,80.5\nB,\nC,NaN\n")
    out = tables.read_csv(spark, str(path), "gp string, LapTime double")
    assert [r.LapTime for r in out.orderBy("gp").collect()] == [80.5, None, None]


def test_checkpoint_file(spark, tmp_path):
    path = tmp_path / "checkpoint.json"
    path.write_text(json.dumps({"completed": ["2022|A|R", "2022|A|Q"], "failed": ["2022|A|Q"]}, indent=2))
    rows = {(r.status, r.key) for r in tables.read_checkpoint(spark, str(path)).collect()}
    assert rows == {("completed", "2022|A|R"), ("completed", "2022|A|Q"), ("failed", "2022|A|Q")}


def test_feature_list_round_trip(spark, tmp_path):
    tables.write_feature_list(spark, str(tmp_path / "f"), ["LapNumber", "Stint"], ["Driver"])
    out = tables.read_feature_list(spark, str(tmp_path / "f")).orderBy("position").collect()
    assert [r.feature for r in out] == ["LapNumber", "Stint", "Driver_te"]
    tables.write_feature_text(spark, str(tmp_path / "t"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_plan_resume_and_outcomes(spark):
    raw = spark.createDataFrame([(2022, "Testing", "0"), (2022, "A", "1"), (2022, "B", "x"), (2021, "C", "2")], "year int, EventName string, RoundNumber string")
    plan = ingest.session_plan(spark, ingest.load_schedule(raw))
    assert {r.key for r in plan.collect()} == {"2022|A|R", "2022|A|Q"}
    log = spark.createDataFrame([("2022|A|R", "failed", 0, 1), ("2022|A|R", "completed", 9, 2), ("2022|A|Q", "failed", 0, 3)], schemas.OUTCOMES)
    assert [r.key for r in ingest.pending(plan, log).collect()] == ["2022|A|Q"]
    assert {r.key: r.status for r in ingest.latest_outcomes(log).collect()} == {"2022|A|R": "completed", "2022|A|Q": "failed"}
    laps = spark.createDataFrame([(2022, "A", "R")], "year int, gp string, session_code string")
    assert {r.key: r.status for r in ingest.outcome(plan, laps).collect()} == {"2022|A|R": "completed", "2022|A|Q": "failed"}


def test_lap_rows_defaults(spark):
    raw = spark.createDataFrame([("44", None, dt.timedelta(seconds=81, milliseconds=250), "x"), (None, "3.0", None, "5")],
                                "DriverNumber string, Stint string, LapTime interval day to second, LapNumber string")
    out = ingest.lap_rows(raw).orderBy("DriverNumber").collect()
    assert [(r.DriverNumber, r.Stint, r.LapTime, r.LapNumber, r.Deleted) for r in out] == [(-1, 3.0, None, 5, False), (44, None, 81.25, -1, False)]


def test_run_log_is_long(spark):
    rows = tables.log_values(spark.createDataFrame([(0.5, 3)], "rmse double, n int"), "run", "metric").collect()
    assert {(r.key, r.value) for r in rows} == {("rmse", "0.5"), ("n", "3")}


def test_append_picks_up_new_columns(spark, tmp_path):
    path = str(tmp_path / "laps")
    tables.append_batch(spark.createDataFrame([(1,)], "a int"), path)
    tables.append_batch(spark.createDataFrame([(2, 3.0)], "a int, b double"), path)
    assert {(r.a, r.b) for r in tables.read_accumulated(spark, path).collect()} == {(1, None), (2, 3.0)}


def test_assembled_laps(spark):
    t0 = dt.datetime(2024, 1, 1)
    laps = spark.createDataFrame([(1, 1, t0), (1, 2, t0 + dt.timedelta(seconds=90))], "session int, LapNumber int, LapStartTime timestamp")
    samples = spark.range(24).select(F.lit(1).alias("session"), F.when(F.col("id") < 20, 1).otherwise(2).alias("LapNumber"),
                                     *[F.col("id").cast("double").alias(c) for c in ("Speed", "Throttle", "Brake", "RPM", "nGear", "DRS")])
    weather = spark.createDataFrame([(1, t0, 20.0, False)], "session int, Time timestamp, AirTemp double, Rainfall boolean")
    messages = spark.createDataFrame([(1, 1, 1, "SafetyCar", "DEPLOYED", "SC DEPLOYED")],
                                     "session int, seq int, Lap int, Category string, Status string, Message string")
    out = ingest.assemble(laps, samples, weather, messages, session=["session"], lap_key=["LapNumber"], message_order=["seq"]).collect()
    assert len(out) == 1 and (out[0].LapNumber, out[0].is_sc, out[0].AirTemp, out[0].Rainfall) == (1, 1, 20.0, 0.0)


class Session:
    """Just what ``shared_dir`` asks a session for."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-test"})


def test_shared_folder_comes_from_the_session():
    assert shared_dir(Session("hdfs://shared/tables/", "yarn")) == "hdfs://shared/tables"
    assert shared_dir(Session(None, "local[2]")) == shared_dir(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(Session(None, "yarn"))


def test_lap_view_is_complete(spark):
    laps = testdata.laps(spark, "/root/testdata/sf0.001")
    lines = testdata.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert laps.count() == lines == laps.select("year", "gp", "session_code", "DriverNumber", "LapNumber").distinct().count()
    assert joins.WEATHER_VALUES[0] in laps.columns


def _shop(spark, path):
    """A small shop: orders without a customer, customers without a nation, null keys, repeated orders, repeated line items."""
    when = "cast('1999-03-04' as timestamp)"
    spark.range(40).selectExpr("id as c_custkey", "cast(if(id % 9 = 0, 99, id % 4) as int) as c_nationkey").write.parquet(f"{path}/customer.parquet")
    orders = spark.range(300).selectExpr("if(id % 50 = 0, null, id) as o_orderkey", "id % 45 as o_custkey", f"{when} + make_interval(0, 0, 0, cast(id * 3 as int)) as o_orderdate")
    orders.unionByName(orders.where("o_orderkey < 20")).write.parquet(f"{path}/orders.parquet")
    spark.range(4).selectExpr("cast(id as int) as n_nationkey", "concat('NATION_', id % 3) as n_name").write.parquet(f"{path}/nation.parquet")
    items = spark.range(2000).selectExpr(
        "if(id % 70 = 0, null, id % 310) as l_orderkey", "id * 7 % 400 as l_partkey", "id * 3 % 90 as l_suppkey", "cast(id % 7 + 1 as int) as l_linenumber",
        "cast(id % 50 + 1 as double) as l_quantity", "id * 3.25 as l_extendedprice", "id % 11 / 100 as l_discount", "id % 9 / 100 as l_tax",
        "substr('RAN', cast(id % 3 + 1 as int), 1) as l_returnflag", "if(id % 2 = 0, 'F', 'O') as l_linestatus", f"{when} as l_shipdate")
    items.selectExpr(*[f"cast({c} as double) {c}" if c in ("l_extendedprice", "l_discount", "l_tax") else c for c in items.columns]).unionByName(
        items.where("l_partkey < 30").selectExpr(*[f"cast({c} as double) {c}" if c in ("l_extendedprice", "l_discount", "l_tax") else c for c in items.columns])
    ).write.parquet(f"{path}/lineitem.parquet")


def test_line_items_move_once_for_their_joins(spark, tmp_path, monkeypatch):
    from lapforge.sources import testdata

    _shop(spark, str(tmp_path))
    laps = testdata.derive_laps(spark, str(tmp_path))
    lines = [(len(x) - len(x.lstrip(" +-:")), x) for x in laps._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = next(i for i, (_, x) in enumerate(lines) if "Relation" in x and "l_extendedprice" in x)
    above, depth = [], lines[at][0]
    for indent, x in reversed(lines[:at]):
        if indent < depth:
            above, depth = [*above, x], indent
    assert sum("Join" in x for x in above) == 1
    monkeypatch.setattr(testdata, "TASK_ROWS", 100)
    spread = testdata.derive_laps(spark, str(tmp_path))
    assert laps.count() > 1000 and laps.exceptAll(spread).isEmpty() and spread.exceptAll(laps).isEmpty()

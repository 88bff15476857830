"""Views that rename the given tables into laps, samples, weather, messages and qualifying results.

Values are quantised to binary fractions so that sums and means are exact in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.operators.segments import group_position
from lapforge.session import fresh_path

#: Rows of lineitem to a task of the joins and windows that make the laps, so that a task sorts them in memory.
TASK_ROWS = 1_000_000

_WRITTEN: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(c):
    return c.cast("int")


def derive_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: the lap fact table."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Orders find their nation first, so that the rows of lineitem move once for all three joins.
    placed_orders = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "n_name", "n_nationkey")
    )
    c = F.col
    tasks = math.ceil(li.count() / TASK_ROWS)
    spread = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spread:
        li, placed_orders = li.repartition(tasks, "l_orderkey"), placed_orders.repartition(tasks, "o_orderkey")
    joined = li.join(placed_orders, c("l_orderkey") == c("o_orderkey"))
    number = (c("l_suppkey") % 10).cast("int")
    tax, discount = F.round(c("l_tax") * 100), F.round(c("l_discount") * 100)
    keyed = joined.select(
        F.year("o_orderdate").alias("year"),
        c("n_name").alias("gp"),
        c("n_nationkey").alias("round"),
        F.when(c("l_returnflag") == "R", "R").when(c("l_returnflag") == "A", "Q").otherwise("T").alias("session_code"),
        number.alias("DriverNumber"),
        *li.columns,
    )
    # The session code leads, so that the rows leave the window in the order in which they are written.
    keys = ["session_code", "year", "gp", "DriverNumber"]
    if spread:
        keyed = keyed.repartition(tasks, *keys)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
             "l_quantity", "l_discount", "l_tax", "l_linestatus"]
    placed = group_position(keyed, keys, order, "lap")
    lap = c("lap").cast("int")
    compounds = ["SOFT", "medium", "HARD", "INTERMEDIATE", "WET", "TEST"]
    compound = F.coalesce(*[F.when(c("l_linenumber") == i, n) for i, n in enumerate(compounds, start=1)])
    return placed.select(
        "year", "gp", "round", "session_code", "DriverNumber",
        F.concat(F.lit("D"), c("DriverNumber")).alias("Driver"),
        F.concat(F.lit("T"), F.floor(c("DriverNumber") / 2)).alias("Team"),
        lap.alias("LapNumber"),
        F.when(c("l_partkey") % 101 != 0,
               F.when(c("l_orderkey") % 97 == 0, 160.0)
               .otherwise(80 + F.floor(c("l_extendedprice") / 8) / 1024)).alias("LapTime"),
        F.when((c("l_linenumber") == 1) & (c("l_orderkey") % 11 == 0), 1.0).alias("PitInTime"),
        F.when((c("l_linenumber") == 2) & (c("l_orderkey") % 11 == 0), 1.0).alias("PitOutTime"),
        F.when(c("l_orderkey") % 13 != 0, discount >= 10).alias("Deleted"),
        compound.alias("Compound"),
        F.when(c("l_linenumber") != 7, 1 + F.floor((lap - 1) / 8)).cast("int").alias("Stint"),
        ((lap - 1) % 8 + 1).cast("double").alias("TyreLife"),
        (1 + c("l_partkey") % 20).cast("double").alias("Position"),
        (1 + c("l_suppkey") % 7).cast("string").alias("TrackStatus"),
        F.when(c("l_partkey") % 103 != 0, 150 + c("l_quantity")).alias("speed_mean"),
        (250 + c("l_quantity")).alias("speed_max"),
        (c("l_quantity") / 8).alias("speed_std"),
        (40 + tax).alias("throttle_mean"),
        (discount / 4).alias("throttle_std"),
        (discount / 64).alias("brake_ratio"),
        (9000 + c("l_quantity") * 16).alias("rpm_mean"),
        (4 + c("l_quantity") / 16).alias("gear_mean"),
        (tax / 64).alias("drs_ratio"),
        _flag(c("l_partkey") % 13 == 0).alias("is_sc"),
        _flag(c("l_partkey") % 17 == 0).alias("is_vsc"),
        _flag(c("l_partkey") % 11 == 0).alias("is_yellow"),
        (20 + c("l_quantity") / 8).alias("AirTemp"),
        (30 + tax * 2).alias("TrackTemp"),
        (40 + c("l_linenumber")).cast("double").alias("Humidity"),
        (1000 + c("l_partkey") % 32).cast("double").alias("Pressure"),
        _flag(c("l_linestatus") == "F").cast("double").alias("Rainfall"),
        (c("l_quantity") / 16).alias("WindSpeed"),
        (c("l_partkey") % 360).cast("double").alias("WindDirection"),
    )


def _written_laps(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir, "laps")
    if key not in _WRITTEN:
        path, derived = fresh_path(spark, "laps"), derive_laps(spark, sf_dir)
        derived.write.partitionBy("session_code").parquet(path)
        _WRITTEN[key] = (path, spark.read.schema(derived.schema).parquet(path))
    return _WRITTEN[key]


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lap table, written once to the shared folder and partitioned by session type."""
    return _written_laps(spark, sf_dir)[1]


def laps_path(spark: SparkSession, sf_dir: str) -> str:
    return _written_laps(spark, sf_dir)[0]


def _event_number():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def telemetry_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "events"))


def as_samples(events: DataFrame) -> DataFrame:
    """Car samples; ten days of one user make a lap, the last digit of the user is the session."""
    k = _event_number()
    return events.select(
        (F.col("user_id") % 10).alias("session"),
        F.col("user_id").alias("driver"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("lap"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.floor(F.col("value") * 16) / 16).alias("Speed"),
        k.cast("double").alias("Throttle"),
        F.when(k % 10 != 9, _flag(F.col("event_type") == "error").cast("double")).alias("Brake"),
        (9000 + F.floor(F.col("value")) * 16).cast("double").alias("RPM"),
        (k % 8).cast("double").alias("nGear"),
        (k % 15).cast("double").alias("DRS"),
        F.when(k % 5 == 0, 80 + F.floor(F.col("value")) / 16).alias("LapTime"),
        (F.floor(F.col("value") * 4) / 4).alias("X"),
        (k / 4).alias("Y"),
    )


def lap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as lap starts; a few have no start time."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "click").select(
        (F.col("user_id") % 10).alias("session"),
        F.col("event_id").alias("lap_id"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("LapStartTime"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as weather readings of sessions 0 to 8, so session 9 has none; some readings miss the rain sensor."""
    k = _event_number()
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "view")
        .select(
            (F.col("user_id") % 9).alias("session"),
            F.col("ts").cast("timestamp").alias("Time"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("AirTemp"),
            (F.col("value") + 10).alias("TrackTemp"),
            k.cast("double").alias("Humidity"),
            (1000 + k).cast("double").alias("Pressure"),
            F.when(k % 10 != 3, k % 2 == 0).alias("Rainfall"),
            (k / 8).alias("WindSpeed"),
            (k * 3).cast("double").alias("WindDirection"),
        )
    )


def race_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as race-control messages; the lap is the hour, unknown for some."""
    k, kind = _event_number(), F.col("event_type")
    virtual = F.when(k % 2 == 1, "Virtual ").otherwise("")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 50 != 0,
               ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int")).alias("Lap"),
        F.when(kind.isin("error", "signup"), "SafetyCar").otherwise("Flag").alias("Category"),
        F.when(kind == "error", "DEPLOYED").when((kind == "signup") & (k % 3 == 0), "ENDING").alias("Status"),
        F.when(kind == "error", F.concat(virtual, F.lit("Safety Car deployed")))
        .when(kind == "signup", F.concat(virtual, F.lit("Safety Car in this lap")))
        .when(kind == "purchase", "Yellow in sector")
        .when(kind == "click", "Clear yellow").alias("Message"),
    )


def quali(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three qualifying rounds per (year, round, driver) from the fastest session-Q laps of each stint third."""
    timed = laps(spark, sf_dir).where((F.col("session_code") == "Q") & F.col("LapTime").isNotNull())

    def fastest(part: int):
        return F.min(F.when(F.col("LapNumber") % 3 == part, F.col("LapTime")))

    by_driver = timed.groupBy("year", "gp", "round", "Driver").agg(
        fastest(1).alias("Q1"), fastest(2).alias("Q2"), fastest(0).alias("q3")
    )
    return by_driver.select(
        "year", "gp", "round", "Driver",
        F.when(F.col("Driver") != "D9", F.length("gp") % 10 + F.substring("Driver", 2, 1).cast("int")).alias("position"),
        "Q1", "Q2",
        F.when(F.col("Driver") == "D3", 0.0).when(F.col("Driver") != "D7", F.col("q3")).alias("Q3"),
    )

"""Previous-lap features on a stream of finished laps.

Each micro-batch runs the ordinary segmented windows over its laps and the last stored laps of their drivers, so nothing of
a group is held in Python. Laps may arrive late: a lap before the last stored one of its driver changes the history of the
laps behind it, and those are computed again and stored anew. The answer is the newest version of every lap, and doesn't
depend on the order of arrival or on the size of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators.history import LOOKBACK, lap_time_columns
from lapforge.operators.segments import SEGMENT_ROWS, open_segments
from lapforge.operators.splits import latest_per_key
from lapforge.session import remove, written_table

FEATURES = ["lap_time_prev", "lap_time_mean_3_prev", "lap_time_delta_prev", "lap_time_std_5_prev"]


def history_in_batches(
    laps: DataFrame, keys: Sequence[str], path: str, state: str, *, order: str = "LapNumber", value: str = "LapTime",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Drain the stream ``laps`` into ``path``; the last laps of every driver live in Parquet under ``state``.

    Batch n reads the laps stored by earlier batches and writes its own folders, so a repeated batch gives the same rows.
    Drivers whose laps come in order cost a read of their last laps; only for late ones the stored laps are read again.
    """
    spark, keys = laps.sparkSession, list(keys)
    columns = [*keys, order, value]
    schema = laps.select(*columns).schema
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], *[f"{n} double" for n in FEATURES], "_batch bigint"])

    def stored_laps(number: int) -> DataFrame:
        return spark.read.option("basePath", path).schema(shape).parquet(path).where(F.col("_batch") < number)

    def store(batch: DataFrame, number: int) -> None:
        arrived = batch.select(*columns).withColumn("_new", F.lit(True))
        if number:
            tails = spark.read.schema(schema).parquet(f"{state}/tails/{number - 1}")
            last = tails.groupBy(*keys).agg(F.max(order).alias("_last"))
            firsts = batch.groupBy(*keys).agg(F.min(order).alias("_first"))
            late = written_table(firsts.join(last, keys).where(F.col("_first") < F.col("_last")).select(*keys, "_first"), "late")
            known = tails.join(late, keys, "left_anti").withColumn("_new", F.lit(False))
            if not late.isEmpty():
                # Stored laps of late drivers, one row each; those that came again in this batch are not among them.
                versions = stored_laps(number).select(*columns, "_batch").unionByName(
                    batch.select(*columns).withColumn("_batch", F.lit(number).cast("bigint"))).join(late, keys)
                newest_version = versions.groupBy(*keys, "_first", order).agg(F.max_by(value, "_batch").alias(value), F.max("_batch").alias("_batch"))
                again = written_table(newest_version.where(F.col("_batch") < number).drop("_batch"), "again")
                # Laps behind the first late one are computed anew; LOOKBACK laps before it are all they need.
                behind = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
                before = Window.partitionBy(*keys, F.col(order) < F.col("_first")).orderBy(F.col(order).desc())
                near = again.where(~behind).withColumn("_rn", F.row_number().over(before)).where(F.col("_rn") <= LOOKBACK)
                known = known.unionByName(again.where(behind).select(*columns, F.lit(True).alias("_new")))
                known = known.unionByName(near.select(*columns, F.lit(False).alias("_new")))
            arrived = arrived.unionByName(known)
        s = open_segments(arrived, keys, [order], depth=LOOKBACK, rows=rows)
        done = s.close(s.frame.withColumns(lap_time_columns(s, value)))
        done.where("_new").drop("_new").write.mode("overwrite").parquet(f"{path}/_batch={number}")
        if number:
            # Few rows are left when equal laps are told apart: the newest orders of a driver, wherever they come from.
            ranked = arrived.unionByName(tails.withColumn("_new", F.lit(None).cast("boolean"))).withColumn("_rn", F.dense_rank().over(newest))
            known_as = F.coalesce(F.col("_new").cast("int"), F.lit(-1))
            last_laps = ranked.where(F.col("_rn") <= LOOKBACK).groupBy(*keys, order).agg(F.max_by(value, known_as).alias(value))
        else:
            last_laps = arrived.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= LOOKBACK)
        last_laps.select(*columns).write.mode("overwrite").parquet(f"{state}/tails/{number}")
        remove(spark, f"{state}/tails/{number - 2}")

    laps.writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/query").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("basePath", path).schema(shape).parquet(path)
    return latest_per_key(out, [*keys, order], ["_batch"]).select(*columns, *FEATURES)

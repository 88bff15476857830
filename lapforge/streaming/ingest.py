"""Incremental ingest: new session files are picked up once, laps and outcomes appended, restarts resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import schemas
from lapforge.functions import scalars as S
from lapforge.session import written_table


def ingest_new_files(
    spark: SparkSession, source: str, schema, target: str, log: str, checkpoint: str, plan: DataFrame | None = None, **options
) -> None:
    """Everything under ``source`` not seen yet -> ``target`` (laps) and ``log`` (one row per session and batch).

    A session whose files hold rows but no lap number, or that ``plan`` (``key``) lists and no file holds, is logged as
    ``failed`` with 0 rows, and again in each run until laps of it arrive.
    """
    stream = spark.readStream.schema(schema).options(**options).parquet(source)

    def outcomes(counts: DataFrame, number: int) -> DataFrame:
        return counts.select("key", F.when(F.col("n_rows") > 0, "completed").otherwise("failed").alias("status"), "n_rows",
                             F.lit(number).cast("bigint").alias("seq"))

    def store(batch: DataFrame, number: int) -> None:
        kept = written_table(batch, "arrived")
        kept.where(F.col("LapNumber").isNotNull()).write.mode("overwrite").parquet(f"{target}/_batch={number}")
        counts = kept.groupBy(S.session_key().alias("key")).agg(F.count("LapNumber").alias("n_rows"))
        outcomes(counts, number).write.mode("overwrite").parquet(f"{log}/_batch={number}")

    query = (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if plan is not None:
        seen = spark.read.schema(schemas.OUTCOMES).parquet(log)
        open_sessions = plan.select("key").join(seen.where("status = 'completed'").select("key"), "key", "left_anti")
        number = (seen.agg(F.max("seq")).first()[0] or 0) + 1
        missing = written_table(outcomes(open_sessions.withColumn("n_rows", F.lit(0).cast("bigint")), number), "missing")
        missing.write.mode("overwrite").parquet(f"{log}/_batch=planned-{number}")

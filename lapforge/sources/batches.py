"""Batches that count once: data first, a manifest last.

A batch writes its rows and its session outcomes into a folder of their own and is committed by one small file that names the
folder, put in place by a rename. Readers follow manifests only, so what a crashed run left behind is never read, and a
batch that is run again takes the place of its earlier version instead of adding to it. Versions are numbered; one batch
must not be committed by two writers at the same time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge import schemas

_MANIFEST = "batch string, version int, folder string"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(batch, version, folder) of the newest version of every committed batch."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return spark.createDataFrame([], _MANIFEST)
    listed = spark.read.schema(_MANIFEST).json(f"{path}/commits")
    return listed.groupBy("batch").agg(F.max(F.struct("version", "folder")).alias("m")).select("batch", "m.*")


def commit(spark: SparkSession, path: str, batch: str, rows: DataFrame, outcomes: DataFrame, before_commit: Callable[[], None] | None = None) -> None:
    """Write rows and outcomes, then the manifest. ``before_commit`` runs between the two, for checks of one's own."""
    earlier = manifests(spark, path).where(F.col("batch") == batch).first()
    version, folder = (earlier.version if earlier else 0) + 1, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}/rows")
    outcomes.write.parquet(f"{path}/data/{folder}/outcomes")
    if before_commit:
        before_commit()
    fs, at = _files(spark, path)
    waiting = at(f"{path}/waiting/{folder}")
    out = fs.create(waiting, False)
    out.write(bytearray((json.dumps({"batch": batch, "version": version, "folder": folder}) + "\n").encode()))
    out.close()
    fs.mkdirs(at(f"{path}/commits"))
    if not fs.rename(waiting, at(f"{path}/commits/{folder}.json")):
        raise RuntimeError(f"batch {batch} could not be committed")


def _committed(spark: SparkSession, path: str, part: str, schema, but: str | None = None) -> DataFrame:
    # One line for each batch: the list of folders is what any reader of a path lists.
    folders = [f"{path}/data/{r.folder}/{part}" for r in manifests(spark, path).collect() if r.batch != but]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def committed_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return _committed(spark, path, "rows", schema)


def committed_outcomes(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """Outcomes of all committed batches, except the one named ``but``."""
    return _committed(spark, path, "outcomes", schemas.OUTCOMES, but)

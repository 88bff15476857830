"""Session settings and the shared folder for tables and streaming checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "lapforge", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit.

    Python workers import this package from the path it was loaded from, wherever the driver was started.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="lapforge-")
    return _LOCAL_SHARED[app]


def _own_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"lapforge-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in this application's part of the shared folder."""
    return os.path.join(_own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's own side tables; a missing one is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every side table of this application. For the end of a job: results not written yet may still read them."""
    remove(spark, _own_dir(spark))


LIST_BYTES = 8 << 20


def listed(df: DataFrame) -> DataFrame | None:
    """A list of groups; None if it is empty. Starts Spark jobs: an empty list costs one, and is never written.

    Otherwise it is written to the shared folder, and marked for a broadcast if the written files are small; a longer list is joined
    like any other table.
    """
    if df.isEmpty():
        return None
    kept = written_table(df, "groups")
    return F.broadcast(kept) if written_bytes(kept) <= LIST_BYTES else kept


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files that a written table is read from."""
    spark = df.sparkSession
    files = df.inputFiles()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)

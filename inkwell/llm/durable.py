"""Cut a lineage at a table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where the session names none, a temporary one in local mode (tests), where all tasks share the machine; else an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def durable(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again; survives lost executors.

    The table replaces the shuffles that made it, so Spark is told to drop
    their files when the write has ended.  (A query that another thread runs
    in the same session meanwhile may have its own shuffles dropped at its own
    end; it would make them again if asked twice.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def state_of(spark: SparkSession, path: str) -> str:
    """A name for a table's files as they are now, within this application: their places, sizes and times of change."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(at)
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join([context.applicationId, *told]).encode()).hexdigest()[:24]


def release(df: DataFrame) -> None:
    """Deletes a table of durable() that nothing will read again."""
    folder = shared_folder(df.sparkSession).rstrip("/")
    context = df.sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    for table in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(table)
        if path.getParent().getName() == folder.rpartition("/")[2]:
            path.getFileSystem(conf).delete(path, True)

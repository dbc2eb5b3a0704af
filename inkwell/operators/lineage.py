"""Cutting a lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where all tasks share the machine."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept there, so that later steps do not compute it again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()

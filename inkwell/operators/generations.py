"""Kept tables in generations: one is written aside and counts from the moment of its commit.

A kept structure is a folder of Parquet tables partitioned by generation, and
a folder of marks.  A writer takes the number after the last mark, writes its
tables under it and sets the mark at the end, in one file operation: what
fails before leaves no trace for readers, and its number is written over by
the next one.  There is one writer at a time; the mark of a number can only be
set once, so a second writer of the same number gets an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "_committed"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the cluster's own objects."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the generations that count: one each, bounded by compaction."""
    files, at = _files(spark, f"{path}/{MARKS}")
    return sorted(int(status.getPath().getName()) for status in files.listStatus(at)) if files.exists(at) else []


def following(spark: SparkSession, path: str) -> int:
    return max(committed(spark, path), default=-1) + 1


def commit(spark: SparkSession, path: str, generation: int) -> None:
    files, at = _files(spark, f"{path}/{MARKS}/{generation}")
    files.create(at, False).close()


def write(rows: DataFrame, path: str, table: str, generation: int, *partitions: str, block: int | None = None) -> None:
    """A table of a generation; block sets the bytes of a row group, for tables that are read in small stretches."""
    writer = rows.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if block:
        writer = writer.option("parquet.block.size", block)
    writer.parquet(f"{path}/{table}/generation={generation}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table over all committed generations, with the column generation."""
    return spark.read.parquet(f"{path}/{table}").where(F.col("generation").isin(*committed(spark, path)))

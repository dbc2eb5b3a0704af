"""Positions of rows in an order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.durable import durable


def numbered(rows: DataFrame, group: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """rows, kept in the shared folder, with position (from 0, in `order`, within `group`) and n, the size of the group.

    The rows are dealt out by ranges of (group, order) and sorted in their
    tasks (without an order they stay where they are), so a group of any size
    spreads over tasks.  What a task holds of a group is a run; the runs'
    counts, a row for each group and task, are summed up to the place where
    each run begins.  group must not be null.
    """
    if order:
        rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = durable(rows.withColumn("__nrow", F.monotonically_increasing_id()))
    task = F.shiftright("__nrow", 33).alias("__task")
    runs = kept.groupBy(task, group).agg(F.min("__nrow").alias("__first"), F.count("*").alias("__count"))
    every = Window.partitionBy(group)
    before = F.coalesce(F.sum("__count").over(every.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = runs.select("__task", group, "__first", before.alias("__before"), F.sum("__count").over(every).alias("n"))
    placed = kept.withColumn("__task", task).join(begins, ["__task", group])
    return placed.withColumn("position", F.col("__nrow") - F.col("__first") + F.col("__before")).drop("__task", "__nrow", "__first", "__before")

"""Counters that only grow, until a process starts again: increases, rates, quantiles of buckets, and spikes.

A sample is (series, ts, total).  What a counter grew since the sample before
is the difference, or the whole total where that is smaller than before: the
counter was reset.  The first sample of a series says nothing about growth.
As a batch this is a window over each series; as a stream it is one remembered
sample a series, so state does not grow with time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _grown(now: Column, before: Column) -> Column:
    return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)


def increases(samples: DataFrame, series: Sequence[str] = ("series",)) -> DataFrame:
    """samples with increase.  A stream's samples of one series come in the order of their times; an older one is left out."""
    if samples.isStreaming:
        return _stream_increases(samples, list(series))
    before = F.lag("total").over(Window.partitionBy(*series).orderBy("ts", "total"))
    return samples.select(*series, "ts", "total", _grown(F.col("total"), before).cast("double").alias("increase"))


def _stream_increases(samples: DataFrame, series: list[str]) -> DataFrame:
    rows = samples.select(*series, F.col("ts").cast("timestamp").alias("ts"), F.col("total").cast("double").alias("total"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(batches)).sort_values(["ts", "total"], kind="stable")
        last_ts, last = state.get if state.exists else (None, None)
        if last_ts is not None:
            told = told[told["ts"] >= pd.Timestamp(last_ts)]
        if not len(told):
            return
        before = told["total"].shift(1)
        if last is not None:
            before.iloc[0] = last
        grown = (told["total"] - before).where(told["total"] >= before, told["total"]).where(before.notna(), 0.0)
        state.update((told["ts"].iloc[-1].to_pydatetime(), float(told["total"].iloc[-1])))
        yield told.assign(increase=grown)[[*series, "ts", "total", "increase"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", increase double"
    return rows.groupBy(*series).applyInPandasWithState(step, schema, "ts timestamp, total double", "append", GroupStateTimeout.NoTimeout)


def rates(grown: DataFrame, by: Sequence[str] = ("series",), every: str = "5 minutes") -> DataFrame:
    """window_start, by, increase, per_second of increases(): counters of several series add up after their resets are undone."""
    summed = grown.groupBy(F.window("ts", every).alias("w"), *by).agg(F.sum("increase").alias("increase"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return summed.select(F.col("w.start").alias("window_start"), *by, "increase", F.round(F.col("increase") / seconds, 6).alias("per_second"))


def bucket_quantiles(grown: DataFrame, p: float, by: Sequence[str] = ("stage",), every: str = "5 minutes") -> DataFrame:
    """window_start, by, quantile from the increases of cumulative bucket counters (column le, the largest one counts all).

    Within the bucket that holds the rank, values are taken as spread evenly;
    the first one starts at 0, and beyond the last finite bound, that is the
    answer.  A window without increases has no quantile.
    """
    summed = grown.groupBy(F.window("ts", every).alias("w"), *by, "le").agg(F.sum("increase").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("le", "n")))
    groups = summed.groupBy("w", *by).agg(listed.alias("l")).withColumn("all", F.element_at("l", -1)["n"]).where("all > 0")
    rank = F.lit(float(p)) * F.col("all")
    finite = F.filter("l", lambda x: x["le"] < float("inf"))
    hit = F.get(F.filter(finite, lambda x: x["n"] >= rank), F.lit(0))
    below = F.element_at(F.concat(F.array(F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n"))), F.filter(finite, lambda x: x["n"] < rank)), -1)
    inside = below["le"] + (hit["le"] - below["le"]) * (rank - below["n"]) / F.nullif(hit["n"] - below["n"], F.lit(0.0))
    told = F.when(hit.isNull(), F.element_at(finite, -1)["le"]).otherwise(F.coalesce(inside, hit["le"]))
    return groups.select(F.col("w.start").alias("window_start"), *by, F.round(told, 6).alias("quantile"))


def spikes(grown: DataFrame, step: int = 900, past: int = 24, offset: int = 4, factor: float = 3.0) -> DataFrame:
    """window_start, recent, baseline (both per second) of the steps that grew `factor` times faster than `past` steps that ended `offset` steps before.

    All series add up.  Steps are numbered, so steps without samples count as
    no growth; the window runs over one row a step.
    """
    number = F.floor(F.unix_timestamp("ts") / step)
    steps = grown.groupBy(number.alias("n")).agg(F.sum("increase").alias("grown"))
    before = Window.partitionBy(F.lit(0)).orderBy("n").rangeBetween(-(offset + past - 1), -offset)
    rated = steps.select("n", (F.col("grown") / step).alias("recent"), (F.coalesce(F.sum("grown").over(before), F.lit(0.0)) / (past * step)).alias("baseline"))
    return rated.where(F.col("recent") > factor * F.col("baseline")).select(F.timestamp_seconds(F.col("n") * step).alias("window_start"), F.round("recent", 6).alias("recent"), F.round("baseline", 6).alias("baseline"))

"""Windowed counters over events; each function works on a batch or a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def watermarked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def rates(events: DataFrame, every: str = "5 minutes") -> DataFrame:
    """window_start, route, n, per_second."""
    counted = watermarked(events).groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("route")).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counted.select(F.col("w.start").alias("window_start"), "route", "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def error_ratio(events: DataFrame, every: str = "1 hour") -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    grouped = watermarked(events).groupBy(F.window("ts", every).alias("w")).agg(bad.alias("errors"), F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "errors", "n", F.round(F.col("errors") / F.col("n"), 6).alias("ratio"))


def quantiles(events: DataFrame, probabilities: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """route and exact quantiles of value; for streams use histogram."""
    return events.groupBy(F.col("event_type").alias("route")).agg(*(F.round(F.percentile("value", p), 6).alias(f"p{round(100 * p)}") for p in probabilities))


def histogram(events: DataFrame, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """route, le, n: cumulative counts per upper bound, all bounds in one pass."""
    cumulative = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(F.col("event_type").alias("route")).agg(*cumulative)
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return wide.select("route", F.inline(pairs))


def histogram_quantile(events: DataFrame, probabilities: Sequence[float] = (0.5, 0.95, 0.99), bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """route and quantiles from bucket counts, so no value is kept.

    Within the bucket that holds the rank, values are taken as spread evenly
    (the first bucket starts at 0); beyond the last bound, it is the answer.
    """
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(F.col("event_type").alias("route")).agg(F.count("value").alias("n"), *counts)
    listed = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))

    def quantile(p: float):
        rank = F.lit(float(p)) * F.col("n")
        hit = F.get(F.filter(listed, lambda x: x["n"] >= rank), F.lit(0))
        below = F.filter(listed, lambda x: x["n"] < rank)
        last = F.get(below, F.size(below) - 1)
        low, under = F.coalesce(last["le"], F.lit(0.0)), F.coalesce(last["n"], F.lit(0))
        inside = low + (hit["le"] - low) * (rank - under) / F.nullif(hit["n"] - under, F.lit(0))
        return F.when(hit.isNull(), float(bounds[-1])).otherwise(F.coalesce(inside, low))

    return wide.select("route", *(F.round(quantile(p), 6).alias(f"p{round(100 * p)}") for p in probabilities))


def usage(calls: DataFrame) -> DataFrame:
    """model, calls, prompt_tokens, completion_tokens, total_tokens: what each model was asked and answered."""
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), *(F.sum(c).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def over_baseline(events: DataFrame, every: str = "1 day", before: int = 3, factor: float = 1.0) -> DataFrame:
    """Windows whose sum of value exceeds factor times the mean of the windows before."""
    sums = events.groupBy(F.window("ts", every).alias("w")).agg(F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "total")
    mean = F.avg("total").over(Window.orderBy("window_start").rowsBetween(-before, -1))  # one row a window
    return sums.withColumn("baseline", mean).where(F.col("total") > factor * F.col("baseline")).select("window_start", F.round("total", 4).alias("total"), F.round("baseline", 4).alias("baseline"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """user_id, started, n: runs of a user's events without a longer pause."""
    grouped = watermarked(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("started"), "n")

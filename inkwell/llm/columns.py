"""Columns that an operator carries along without reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(docs: DataFrame, needed: Sequence[str]) -> list[str]:
    first: set[str] = set()
    out = []
    for i, c in enumerate(docs.columns):
        out.append(c if c in needed and c not in first else f"__aside_{i}")
        first.add(c)
    return out


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all other columns under neutral names, so that none can clash with an operator's own, in whatever case it is written."""
    return docs.toDF(*_names(docs, needed))


def back(rows: DataFrame, docs: DataFrame, needed: Sequence[str], own: Sequence[str] = ()) -> DataFrame:
    """The columns of docs under their names and in their order, then `own`; columns of docs that are named like one of `own` are replaced."""
    taken = {c.lower() for c in own}
    kept = [F.col(n).alias(c) for n, c in zip(_names(docs, needed), docs.columns, strict=True) if n == c or c.lower() not in taken]
    return rows.select(*kept, *own)


def once(value: Column, f) -> Column:
    """f(value) with value computed a single time, also where f uses it inside a lambda that runs for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """The sums of values[0..i] for every i.

    An array that grows by one element a step is copied each time, so sums are
    made within blocks first and then over the blocks.
    """
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    sums = lambda xs: F.aggregate(xs, none, lambda acc, x: F.array_append(acc, (last(acc) + x).cast("int")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: sums(F.slice(v, b * block + 1, F.lit(block))))

    def joined(local: Column) -> Column:
        ends = sums(F.transform(local, last))
        return once(ends, lambda e: F.flatten(F.transform(local, lambda xs, i: F.transform(xs, lambda x: x + F.when(i == 0, 0).otherwise(F.get(e, i - 1))))))

    return once(values, lambda v: F.when(F.size(v) > 0, once(blocks(v), joined)).otherwise(none))

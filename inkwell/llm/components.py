"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.durable import durable, release


#: A round's table has one file for so many rows of the round before: where Hadoop has no native library, each file costs a child process of the executor.
ROWS_A_FILE = 20_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of them and itself; edges have u > v."""
    around = edges.select("u", "v")
    if large:
        around = around.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where(F.col("u") > F.col("v"))
    return out if large else out.distinct()  # the small star that follows drops the large one's repeats


def components(links: DataFrame) -> DataFrame:
    """u, v: every linked node but the smallest of its component, and that smallest one.

    links has two columns of numbers, a and b.  Every round is written to the
    shared folder, so lineage stays short; rounds grow with the logarithm of
    the size of the largest component.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct()
    edges = durable(edges)
    state = _state(edges)
    while state[0]:
        before, older = state, edges
        edges = durable(_star(_star(older, large=True), large=False).coalesce(1 + state[0] // ROWS_A_FILE))
        state = _state(edges)
        release(older)
        if state == before:
            break
    return edges

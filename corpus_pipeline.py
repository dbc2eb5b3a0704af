"""The training-corpus pipeline: STAGES in order, each over all that the one before kept.

Each stage is written as Parquet and read again as the next one's docs.  The
stages: documents that the byte-level classifier rejects go; repeated runs of
lines are cut from texts; one document of each near-duplicate class stays;
documents with a benchmark window go; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import byte_cnn, decontaminate, line_winnow, order_minhash, packing
from inkwell.llm.durable import durable

NEEDED = ("doc_id", "text")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns that no operator needs under neutral names, so that none can clash with an operator's own."""
    return docs.select(*NEEDED, *(F.col(f"`{c}`").alias(f"__pl_{i}") for i, c in enumerate(docs.columns) if c not in NEEDED))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names and in their order."""
    return rows.select(*(F.col(c if c in NEEDED else f"__pl_{i}").alias(c) for i, c in enumerate(docs.columns)))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least the operator's threshold."""
    model = byte_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(byte_cnn.score(_aside(docs), model).where(F.col("score") >= byte_cnn.THRESHOLD), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines; a document of which nothing is left by that goes."""
    cut = line_winnow.dedup_lines(_aside(docs))
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        held = f"__pl_{docs.columns.index('n_chars')}"
        kept = kept.withColumn(held, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(held)).cast(docs.schema["n_chars"].dataType))
    return _back(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each class that has the smallest doc_id, and those without a class."""
    classes = order_minhash.near_duplicate_classes(docs)
    gone = classes.where(F.col("doc_id") > F.col("class_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without any benchmark window."""
    found = decontaminate.find_contamination(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where(F.size("hit_words") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import byte_buckets, byte_cnn, decontaminate, exact_dedup, license_scan, line_winnow, merkle, order_minhash, packing, quality_ledger, resample, secret_scan, suffix_trees
from inkwell.llm.durable import shared_folder, state_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents, measured by the first query that asks and kept for the others."""
    path = f"{shared_folder(spark)}/ledger-{state_of(spark, f'{sf_dir}/documents.parquet')}"
    if not quality_ledger.is_stored(spark, path):
        quality_ledger.store(_table(spark, sf_dir, "documents"), path)
    return quality_ledger.stored(spark, path)


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.apply_policy(_ledger(spark, sf_dir), quality_ledger.POLICIES[-1])
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_ledger.POLICIES[0].mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1's ledger asked what each policy keeps, whole ('') and without each of its rules."""
    return quality_ledger.ablations(_ledger(spark, sf_dir)).fillna("", ["without_rule"])


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = byte_cnn.train(docs, _table(spark, sf_dir, "labels"))
    scored = byte_cnn.score(docs, model)
    return scored.select("doc_id", byte_cnn.held_out().alias("held_out"), "score", (F.col("score") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_left(spark, sf_dir, line_winnow.WORDS)


def line_winnow_runs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 without its rule for runs of one or two long lines."""
    return _lines_left(spark, sf_dir, None)


def _lines_left(spark: SparkSession, sf_dir: str, words: int | None) -> DataFrame:
    docs = line_winnow.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=words)
    return docs.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.digest(_table(spark, sf_dir, "documents"))


def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("stays"))


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op10_byte_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_buckets.digest(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"quality_ablations": quality_ablations, "line_winnow_runs_only": line_winnow_runs_only}


def oracle_sql() -> dict[str, str]:
    from inkwell.llm.oracles import ORACLES

    return dict(ORACLES)

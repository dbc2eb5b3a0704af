"""Whole jobs made of other operators: reviews with retrieval for each section, and experiments of whole papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import corpus, documents, library, payloads, retrieval, search

NOTHING = "The available papers do not cover this aspect."


def sources_of(reviews: DataFrame, papers: DataFrame, limit: int = 40) -> DataFrame:
    """review_id, source_index, paper_id, title: the papers of each review (review_id, paper_id), newest first, at most `limit`."""
    order = Window.partitionBy("review_id").orderBy(F.desc(F.coalesce("published_year", F.lit(0))), "paper_id")
    named = reviews.select("review_id", "paper_id").distinct().join(papers.select("paper_id", "title", "published_year"), "paper_id")
    return named.withColumn("source_index", F.row_number().over(order)).where(F.col("source_index") <= limit).select("review_id", "source_index", "paper_id", "title")


def section_passages(spark: SparkSession, keywords: str, vectors: str, sections: DataFrame, sources: DataFrame, chunks: DataFrame, limit: int = 6, dim: int = 384) -> DataFrame:
    """review_id, section_no, source_index, rank, chunk_id, body: what each section may draw on.

    sections: review_id, section_no, topic, heading, focus; chunks: chunk_id,
    paper_id, content, section_path; the indexes are keyed by chunk_id.  All
    sections of all reviews are questions of one search, and each only sees
    the chunks of its own review's sources.
    """
    said = F.trim(F.concat_ws(". ", "topic", "heading", "focus"))
    asked = sections.select(F.concat_ws("/", F.col("review_id").cast("string"), F.col("section_no").cast("string")).alias("query_id"), said.alias("query"), "review_id", "section_no")
    owned = chunks.select(F.col("chunk_id").alias("key"), "paper_id").join(sources.select("review_id", "paper_id", "source_index"), "paper_id")
    scope = asked.select("query_id", "review_id").join(owned.select("review_id", "key"), "review_id").select("query_id", "key")
    hits = search.retrieve_many(spark, keywords, vectors, retrieval.hash_vectors(asked.select("query_id", "query"), "query", dim), limit, scope=scope)
    found = hits.select("query_id", "key", "rank").join(asked.select("query_id", "review_id", "section_no"), "query_id").join(owned, ["review_id", "key"])
    told = F.format_string("[%d] %s (%s)\n%s", "source_index", "title", F.coalesce(F.nullif("section_path", F.lit("")), F.lit("body")), F.trim("content"))
    texts = chunks.select(F.col("chunk_id").alias("key"), "content", "section_path")
    named = found.join(sources.select("review_id", "source_index", "title"), ["review_id", "source_index"]).join(texts, "key")
    return named.select("review_id", "section_no", "source_index", "rank", F.col("key").alias("chunk_id"), told.alias("body"))


def drafted(sections: DataFrame, passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Sections as cited_sections() and review_markdown() take them: a model's text for each (review_id, section_no, text), and the sources it was given.

    A section without passages says so; one whose text did not come says that.
    """
    on = ["review_id", "section_no"]
    given = passages.groupBy(*on).agg(F.array_sort(F.collect_set("source_index")).alias("available"))
    rows = sections.join(given, on, "left").join(texts.select(*on, F.col("text").alias("__text")), on, "left")
    text = F.when(F.col("available").isNull(), NOTHING).when(F.col("__text").isNull(), "This section could not be generated.").otherwise(F.trim("__text"))
    return rows.withColumn("text", text).withColumn("available", F.coalesce("available", F.array().cast("array<int>"))).drop("__text")


def extracted_passages(passages: DataFrame, sections: DataFrame, most: int = 2) -> DataFrame:
    """review_id, section_no, text without a model: the first sentences of a section's best passages, each with its source's marker."""
    best = passages.where(F.col("rank") <= most)
    first = F.get(tx.sentences(F.regexp_replace("body", r"^[^\n]*\n", "")), F.lit(0))
    said = best.withColumn("s", F.concat(first, F.lit(" ["), F.col("source_index").cast("string"), F.lit("]"))).where("s IS NOT NULL")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "s"))), lambda z: z["s"]), " ")
    return said.groupBy("review_id", "section_no").agg(listed.alias("text")).join(sections.select("review_id", "section_no"), ["review_id", "section_no"], "left_semi")


def literature_reviews(sections: DataFrame, sources: DataFrame, passages: DataFrame, texts: DataFrame) -> DataFrame:
    """review_id, n_words, n_cited, markdown of all reviews; citations are checked against what each section was given."""
    return corpus.review_markdown(drafted(sections, passages, texts), sources.withColumn("citation", F.col("title")))


def experiments(papers: DataFrame, chunks: DataFrame, replies: DataFrame | None = None, datasets=None, first: int = 40, limit: int | None = lx.RESULT_TEXT_CHARS) -> DataFrame:
    """paper_id, model, dataset, task, metric, value, unit, split, confidence of each paper's abstract and first chunks.

    The rules name a result's model by the paper's title.  A model's replies
    (paper_id, reply) win; rule results only fill metrics that a paper's
    replies lack.  limit is that of a model prompt; None reads whole texts.
    """
    text = documents.extraction_text(papers, chunks, first, limit)
    ruled = documents.reported_results(text, datasets, "paper_id").drop("model", "evidence").join(papers.select("paper_id", F.substring("title", 1, 80).alias("model")), "paper_id")
    names = ["paper_id", "model", "dataset", "task", "metric", "value", "unit", "split", "confidence"]
    rows = ruled.withColumns({"task": F.lit(None).cast("string"), "split": F.lit(None).cast("string")}).select(*names)
    if replies is None:
        return rows
    return documents.merge_results(payloads.results(replies).select(*names), rows, "paper_id")


def store_experiments(results: DataFrame, examined: DataFrame, path: str) -> None:
    """Replaces the stored results of all examined papers (paper_id), also of those that have none now, in one commit."""
    keyed = results.withColumns({"model_key": tx.normalize_key("model"), "dataset_key": tx.normalize_key("dataset"), "metric_key": tx.canonical_metric(F.col("metric"))})
    none = examined.select("paper_id").distinct().join(results.select("paper_id"), "paper_id", "left_anti").withColumn("__gone", F.lit(True))
    library.write_replacing(keyed.withColumn("__gone", F.lit(False)).unionByName(none, allowMissingColumns=True), path)

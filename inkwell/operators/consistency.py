"""Where papers agree and where they do not: claim pairs judged by a model, once each, and numeric conflicts.

Judging is resumable work.  A pair has a key (its papers and claim numbers, so
equal titles never meet) and the hash of its prompt; replies are kept in a
store by key.  Only pairs without a reply to their present prompt are asked,
so a run that was broken off goes on where it ended, and a second one asks
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import payloads
from inkwell.sources import replacing

KEY = ("left_paper", "left_no", "right_paper", "right_no")
PROMPT = "Do these two claims agree, contradict each other, or speak of different things?"


def pair_work(pairs: DataFrame, stated: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """Candidate pairs (claim_pairs()) with both claims, pair_key, the prompt's text and its hash."""
    side = lambda s: stated.select(F.col("paper_id").alias(f"{s}_paper"), F.col("claim_no").alias(f"{s}_no"), F.col("claim").alias(f"{s}_claim"))
    both = pairs.join(side("left"), ["left_paper", "left_no"]).join(side("right"), ["right_paper", "right_no"])
    text = F.concat(F.lit(f"{prompt}\n\nClaim A: "), "left_claim", F.lit("\n\nClaim B: "), "right_claim")
    asked = both.withColumn("pair_key", F.concat_ws("/", *(F.col(c).cast("string") for c in KEY))).withColumn("prompt", text)
    return asked.withColumn("prompt_hash", F.sha2("prompt", 256))


def replies(spark: SparkSession, path: str) -> DataFrame:
    """pair_key, prompt_hash, reply as stored; a store that was never written to is empty."""
    if not replacing.has(spark, path):
        return spark.createDataFrame([], "pair_key string, prompt_hash string, reply string")
    return replacing.read(spark, path, "pair_key").select("pair_key", "prompt_hash", "reply")


def pending(work: DataFrame, path: str) -> DataFrame:
    """The pairs without a reply to their present prompt."""
    return work.join(replies(work.sparkSession, path).select("pair_key", "prompt_hash"), ["pair_key", "prompt_hash"], "left_anti")


def judge_pending(work: DataFrame, path: str, judge: Callable[[DataFrame], DataFrame]) -> int:
    """Asks the judge (rows with prompt in, with reply out) about what is pending, stores the replies that came, and gives their number."""
    todo = pending(work, path)
    if todo.isEmpty():
        return 0
    before = len(replacing.entries(work.sparkSession, path)) if replacing.has(work.sparkSession, path) else 0
    replacing.write(judge(todo).where("reply IS NOT NULL").select("pair_key", "prompt_hash", "reply"), path, "pair_key")
    return sum(e["rows"] for e in replacing.entries(work.sparkSession, path)[before:])


def judged_pairs(work: DataFrame, path: str) -> DataFrame:
    """Both claims of each pair with its relation, confidence and reason; pairs without a reply are unjudged (null)."""
    told = payloads.judgements(work.select("pair_key", "prompt_hash").join(replies(work.sparkSession, path), ["pair_key", "prompt_hash"]), "pair_key")
    return work.join(told, "pair_key", "left").select(*KEY, "left_claim", "right_claim", "overlap", "relation", "confidence", "reason")


def report(conflicts: DataFrame, judged: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: papers_examined, numeric_conflicts, contradictions, agreements, unjudged, is_consistent, summary.

    Numeric conflicts are counted from conflict_counts(), or from
    conflict_ranges(), a pair once by its smaller value, so no pair is formed
    for the count.
    """
    numeric = conflicts.agg(F.coalesce(F.sum("n_conflicts" if "n_conflicts" in conflicts.columns else "n_above"), F.lit(0)).alias("numeric_conflicts"))
    claims = judged.agg(F.count_if(F.col("relation") == "contradiction").alias("contradictions"), F.count_if(F.col("relation") == "agreement").alias("agreements"), F.count_if(F.col("relation").isNull()).alias("unjudged"))
    one = papers.agg(F.countDistinct("paper_id").alias("papers_examined")).crossJoin(numeric).crossJoin(claims)  # a row each
    fine = (F.col("numeric_conflicts") == 0) & (F.col("contradictions") == 0)
    summary = F.when(F.col("papers_examined") < 2, "At least two papers are needed to compare claims.").when(fine, F.format_string("No conflicts found across %d papers.", "papers_examined"))
    told = summary.otherwise(F.format_string("%d numeric conflict(s) and %d contradicting claim(s) across %d papers.", "numeric_conflicts", "contradictions", "papers_examined"))
    return one.withColumn("is_consistent", fine).withColumn("summary", told)

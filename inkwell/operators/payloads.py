"""Model replies as typed rows: JSON is parsed by Spark, checked against closed vocabularies, and cut to column sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import graph

LABELS = ("Paper", "Author", "Institution", "Dataset", "Model", "Task", "Metric", "Method", "Benchmark", "Venue")


def _listed(raw: str, field: str, item: str) -> Column:
    """The objects of a list in a reply; an unreadable reply or a missing list is empty."""
    parsed = F.from_json(tx.json_object(raw), f"{field} array<struct<{item}>>")[field]
    return F.filter(F.coalesce(parsed, F.array().cast(f"array<struct<{item}>>")), lambda x: x.isNotNull())


def _cut(column: str, size: int) -> Column:
    return F.nullif(F.substring(F.trim(F.col(column)), 1, size), F.lit(""))


def entities(replies: DataFrame, key: str = "paper_id", raw: str = "reply") -> DataFrame:
    """key, label, name, entity_key, confidence, evidence: entities of known labels with a name, one row per (label, key)."""
    rows = replies.select(key, F.inline(_listed(raw, "entities", "type string, name string, confidence string, evidence string")))
    named = rows.select(key, F.initcap("type").alias("label"), _cut("name", 255).alias("name"), tx.clamp_confidence("confidence").alias("confidence"), _cut("evidence", 400).alias("evidence"))
    known = named.where(F.col("label").isin(*[x for x in LABELS if x != "Paper"])).withColumn("entity_key", tx.normalize_key("name")).where("entity_key <> ''")
    best = F.max_by(F.struct("name", "confidence", "evidence"), F.struct("confidence", "name")).alias("b")
    return known.groupBy(key, "label", "entity_key").agg(best).select(key, "label", "entity_key", "b.*")


def relations(replies: DataFrame, papers: DataFrame, found: DataFrame, key: str = "paper_id", raw: str = "reply") -> DataFrame:
    """Edges of known relations whose ends are a paper's title or one of the document's entities."""
    rows = replies.select(key, F.inline(_listed(raw, "relations", "type string, source string, target string, confidence string")))
    typed = rows.select(F.col(key).alias("paper_id"), F.upper("type").alias("type"), "source", "target").where(F.col("type").isin(*lx.LEGAL_EDGES))
    return graph.resolve_relations(typed, papers, found.select(F.col(key).alias("paper_id"), "label", F.col("entity_key").alias("key")))


def results(replies: DataFrame, key: str = "paper_id", raw: str = "reply", most: int = 200) -> DataFrame:
    """key, model, dataset, task, metric, value, unit, split, confidence: results with a model, a metric and a number."""
    rows = replies.select(key, F.posexplode(_listed(raw, "results", "model string, dataset string, task string, metric string, value string, unit string, split string, confidence string")).alias("at", "r")).select(key, "at", "r.*")
    typed = rows.select(
        key, "at", _cut("model", 255).alias("model"), _cut("dataset", 255).alias("dataset"), _cut("task", 255).alias("task"), tx.canonical_metric(_cut("metric", 128)).alias("metric"),
        F.col("value").try_cast("double").alias("value"), _cut("unit", 32).alias("unit"), _cut("split", 64).alias("split"), tx.clamp_confidence("confidence").alias("confidence"),
    )
    return typed.where((F.col("at") < most) & F.col("model").isNotNull() & (F.col("metric") != "") & F.col("value").isNotNull()).drop("at")


def methodology(replies: DataFrame, key: str = "paper_id", raw: str = "reply") -> DataFrame:
    """key, approach, architecture, training, hyperparameters (name = value), limitations; replies without any are dropped."""
    item = "approach string, architecture string, training string, hyperparameters array<struct<name: string, value: string>>, limitations array<string>"
    rows = replies.select(key, F.from_json(tx.json_object(raw), item).alias("m")).select(key, "m.*")
    pairs = F.transform(F.filter("hyperparameters", lambda h: h["name"].isNotNull()), lambda h: F.concat_ws(" = ", h["name"], h["value"]))
    typed = rows.select(key, *(_cut(c, 2000).alias(c) for c in ("approach", "architecture", "training")), F.coalesce(pairs, F.array().cast("array<string>")).alias("hyperparameters"), F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"))
    return typed.where(F.col("approach").isNotNull() | F.col("architecture").isNotNull() | F.col("training").isNotNull() | (F.size("limitations") > 0))


def gaps(replies: DataFrame, key: str = "paper_id", raw: str = "reply", n_sources: int = 40) -> DataFrame:
    """key, gap, rationale, direction, confidence, evidence: gaps with a text, evidence limited to sources that were given."""
    rows = replies.select(key, F.inline(_listed(raw, "gaps", "gap string, rationale string, evidence_indices array<int>, suggested_direction string, confidence string")))
    given = F.array_sort(F.array_distinct(F.filter("evidence_indices", lambda i: i.between(1, n_sources))))
    return rows.select(key, _cut("gap", 400).alias("gap"), _cut("rationale", 2000).alias("rationale"), _cut("suggested_direction", 400).alias("direction"), tx.clamp_confidence("confidence").alias("confidence"), F.coalesce(given, F.array().cast("array<int>")).alias("evidence")).where("gap IS NOT NULL")


def judgements(replies: DataFrame, key: str = "pair_id", raw: str = "reply") -> DataFrame:
    """key, relation, confidence, reason; an unknown or unreadable relation is unrelated."""
    rows = replies.select(key, F.from_json(tx.json_object(raw), "relation string, confidence string, reason string").alias("j")).select(key, "j.*")
    relation = F.lower(F.trim("relation"))
    known = F.when(relation.isin("agreement", "contradiction", "unrelated"), relation).otherwise("unrelated")
    return rows.select(key, known.alias("relation"), tx.clamp_confidence("confidence").alias("confidence"), _cut("reason", 400).alias("reason"))


def outline(replies: DataFrame, key: str = "review_id", raw: str = "reply", most: int = 8) -> DataFrame:
    """key, section_no, heading, focus: the sections of an outline; four default ones where none can be read."""
    default = F.array(*(F.struct(F.lit(h).alias("heading"), F.lit(f).alias("focus")) for h, f in DEFAULT_SECTIONS))
    listed = F.slice(F.filter(_listed(raw, "sections", "heading string, focus string"), lambda s: F.trim(s["heading"]) != ""), 1, most)
    return replies.select(key, F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(default)).alias("section_no", "s")).select(key, "section_no", "s.*")


# The sections of a review without an outline.
DEFAULT_SECTIONS = (
    ("Overview", "What problem this area addresses and why it matters"),
    ("Approaches", "The main methods and how they differ"),
    ("Evaluation", "Datasets, benchmarks, and reported results"),
    ("Open problems", "Limitations the papers themselves identify"),
)


def bibtex(sources: DataFrame) -> DataFrame:
    """paper_id, entry: a BibTeX record per source (paper_id, authors, year, title, venue); repeated keys get a letter."""
    keyed = sources.withColumn("base", tx.bibtex_key(F.col("authors"), F.col("year"), F.col("title")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("paper_id"))
    label = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.char(F.lit(95) + n)))
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    names = F.array_join(tx.authors("authors"), " and ")
    body = F.concat_ws(",\n", F.concat(F.lit("@article{"), label), field("title", F.col("title")), field("author", names), field("year", F.col("year").cast("string")), field("journal", F.col("venue")))
    return keyed.select("paper_id", F.concat(body, F.lit("\n}")).alias("entry"))


def save_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)

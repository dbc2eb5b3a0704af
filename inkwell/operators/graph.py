"""The property graph as two tables: nodes(uid, ...) and edges(src, type, dst); a uid is Label:key."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators.lineage import cut
from inkwell.sources import replacing

EDGE = ("src", "type", "dst")


def label_of(uid: str) -> Column:
    return F.substring_index(F.col(uid), ":", 1)


def legal(edges: DataFrame) -> DataFrame:
    """Edges whose relation may connect the labels of their ends; the rest is dropped."""
    spark = edges.sparkSession
    table = spark.createDataFrame([(t, a, b) for t, (a, b) in lx.LEGAL_EDGES.items()], "type string, start_label string, end_label string")
    marked = edges.withColumn("start_label", label_of("src")).withColumn("end_label", label_of("dst"))
    return marked.join(F.broadcast(table), ["type", "start_label", "end_label"]).select("src", "type", "dst")


def nodes_of(edges: DataFrame) -> DataFrame:
    """uid, label of all ends: edges create their nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    return ends.select("uid", label_of("uid").alias("label"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes (uid, label, props) after adding new ones; properties merge by key, the new value wins."""
    both = nodes.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    entry = both.select("uid", "label", "__new", F.explode_outer("props").alias("k", "v"))
    last = entry.groupBy("uid", "label", "k").agg(F.max_by("v", F.struct("__new", "v")).alias("v"))
    merged = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))))
    return last.groupBy("uid", "label").agg(merged.alias("props"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """An edge that is added again replaces the one there was.  Only edges of the relations that new has are looked at for that."""
    keys = list(EDGE)
    new = cut(new.dropDuplicates(keys))
    kinds = [r["type"] for r in new.select("type").distinct().collect()]  # the relations of the schema
    touched = F.coalesce(F.col("type").isin(*(k for k in kinds if k is not None)), F.lit(False))
    kept = edges.where(touched).join(new.select(*keys), keys, "left_anti")
    return edges.where(~touched).unionByName(kept).unionByName(new)


#: So many missing ends are compared in every task, so edges need not be shuffled by their ends.
_FEW_ENDS = 1000


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges whose ends are both nodes.

    The different ends that are no node are found first, and kept.  Mostly
    they are few, and edges stay where they are; otherwise edges are joined
    with them by source and by destination.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uid")).where("uid IS NOT NULL").distinct()
    missing = cut(ends.join(nodes.select("uid"), "uid", "left_anti"))
    told = missing if missing.limit(_FEW_ENDS + 1).count() > _FEW_ENDS else F.broadcast(missing)
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    return whole.join(told.withColumnRenamed("uid", "src"), "src", "left_anti").join(told.withColumnRenamed("uid", "dst"), "dst", "left_anti").select(*edges.columns)


def delete_node(nodes: DataFrame, edges: DataFrame, uid: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("uid") != uid), edges.where((F.col("src") != uid) & (F.col("dst") != uid))


def find_nodes(nodes: DataFrame, label: str | None = None, contains: str = "", limit: int = 50) -> DataFrame:
    key = F.substring(F.col("uid"), F.length("label") + F.lit(2), F.lit(2**30))
    scoped = nodes if label is None else nodes.where(F.col("label") == label)
    return scoped.withColumn("key", key).where(F.col("key").contains(contains.lower())).orderBy("key", "label").limit(limit)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(edges.agg(F.lit("_relationships").alias("label"), F.count("*").alias("n")))


def neighbors(edges: DataFrame, start: str, depth: int = 1, types: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """uid, distance, direction of all nodes within depth hops over edges of both directions.

    One join per hop from the frontier; nodes seen before are anti-joined, so
    each node comes at its smallest distance.  direction is that of the
    discovering edge (out before in where both discover it).
    """
    used = edges.where(F.col("type").isin(*types)) if types else edges
    step = used.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit("out").alias("direction")).unionByName(used.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit("in").alias("direction")))
    # The first hop is a pushed-down filter.  More hops read the edges and the frontier before again, so both are kept.
    step = cut(step) if depth > 1 else step
    frontier = step.where(F.col("at") == start).where(F.col("to") != start).groupBy(F.col("to").alias("uid")).agg(F.max("direction").alias("direction")).withColumn("distance", F.lit(1))
    frontier = cut(frontier) if depth > 1 else frontier
    seen = frontier
    for hop in range(2, depth + 1):
        reached = step.join(frontier.select(F.col("uid").alias("at")), "at").where(F.col("to") != start)
        found = reached.groupBy(F.col("to").alias("uid")).agg(F.max("direction").alias("direction"))
        frontier = cut(found.join(seen.select("uid"), "uid", "left_anti").withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen if limit is None else seen.orderBy("distance", "uid").limit(limit)


_SEEDS_A_BLOCK = 64


def neighbors_of(edges: DataFrame, seeds: DataFrame, depth: int = 1, types: Sequence[str] = ()) -> DataFrame:
    """start, uid, distance, direction: neighbors() of every seed (uid) at once, in as many joins as for one.

    Seeds are numbered, and 64 of them share a row: bit i of a node's set says
    that seed i has reached it.  A hop joins the frontier's sets with the
    edges, unites what arrives at a node by bit_or, before and after the
    shuffle, and drops the bits the node had.
    """
    used = edges.where(F.col("type").isin(*types)) if types else edges
    both = used.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(True).alias("out")).unionByName(used.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(False).alias("out")))
    step = cut(both)
    row = F.monotonically_increasing_id()
    # Numbers depend on where a row is read, so they are kept.
    named = cut(seeds.select(F.col("uid").alias("start")).where("start IS NOT NULL").distinct().withColumn("n", row).withColumn("block", F.floor(F.col("n") / _SEEDS_A_BLOCK)).withColumn("bit", (F.col("n") % _SEEDS_A_BLOCK).cast("int")))
    bit = F.expr("shiftleft(1L, bit)")
    frontier = named.groupBy("block", F.col("start").alias("uid")).agg(F.bit_or(bit).alias("bits"))
    seen, found = frontier, []
    for hop in range(1, depth + 1):
        met = step.join(frontier.select("block", F.col("uid").alias("at"), "bits"), "at")
        side = lambda out: F.bit_or(F.when(F.col("out") == out, F.col("bits")).otherwise(F.lit(0).cast("long")))
        reached = met.groupBy("block", F.col("to").alias("uid")).agg(side(True).alias("by_out"), side(False).alias("by_in"))
        known = seen.select("block", "uid", F.col("bits").alias("had"))
        fresh = F.col("by_out").bitwiseOR(F.col("by_in")).bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        frontier = cut(reached.join(known, ["block", "uid"], "left").withColumn("bits", fresh).where("bits <> 0").select("block", "uid", "bits", F.col("by_out").bitwiseAND(F.col("bits")).alias("out_bits")))
        found.append(frontier.withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier.select("block", "uid", "bits")).groupBy("block", "uid").agg(F.bit_or("bits").alias("bits"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spread = every.join(named.select("block", "bit", "start"), "block").where("shiftrightunsigned(bits, bit) & 1 = 1")
    return spread.select("start", "uid", "distance", F.when(F.expr("shiftrightunsigned(out_bits, bit) & 1 = 1"), "out").otherwise("in").alias("direction"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Stores nodes (uid, label, props) and edges (src, type, dst); properties of stored nodes are merged, edges replaced.

    Each of the two writes commits as a whole; nodes come last, and loading
    drops edges without both ends, so a reader between them sees no half edge.
    """
    spark = nodes.sparkSession
    replacing.write(edges.select(*EDGE).distinct().withColumn("edge", F.concat_ws("\t", *EDGE)), f"{path}/edges", "edge")
    have = replacing.has(spark, f"{path}/nodes")
    old = replacing.read(spark, f"{path}/nodes", "uid").join(nodes.select("uid"), "uid", "left_semi").select("uid", "label", "props") if have else nodes.select("uid", "label", "props").limit(0)
    replacing.write(upsert_nodes(old, nodes.select("uid", "label", "props")), f"{path}/nodes", "uid")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes, edges as stored, without edges that lack an end."""
    nodes = replacing.read(spark, f"{path}/nodes", "uid")
    return nodes, drop_dangling(nodes, replacing.read(spark, f"{path}/edges", "edge").select(*EDGE)).select(*EDGE)


def match_pattern(edges: DataFrame, start_label: str, relation: str, end_label: str, limit: int = 100) -> DataFrame:
    """(start)-[relation]->(end) as plain filters; labels and relations outside the schema are refused."""
    if relation not in lx.LEGAL_EDGES or (start_label, end_label) != lx.LEGAL_EDGES[relation]:
        raise ValueError(f"not in the graph's schema: ({start_label})-[{relation}]->({end_label})")
    hits = edges.where((F.col("type") == relation) & F.col("src").startswith(start_label + ":") & F.col("dst").startswith(end_label + ":"))
    return hits.select("src", "dst").orderBy("src", "dst").limit(min(limit, 100))


_PATTERN = re.compile(r"\s*MATCH\s*\(\w*:(\w+)\)-\[\w*:(\w+)\]->\(\w*:(\w+)\)\s*RETURN\s+[\w.,\s]+?(?:LIMIT\s+(\d+))?\s*;?\s*", re.IGNORECASE)


def read_only_query(edges: DataFrame, query: str) -> DataFrame:
    """Runs a one-edge MATCH ... RETURN question; anything else, and so every write, is refused."""
    found = _PATTERN.fullmatch(re.sub(r"^`{3}\w*|`{3}$", "", query.strip()).strip())
    if not found:
        raise ValueError("only MATCH (:Label)-[:RELATION]->(:Label) RETURN ... [LIMIT n] is answered")
    return match_pattern(edges, found[1], found[2].upper(), found[3], int(found[4] or 100))


def coauthors(authors: DataFrame, limit: int = 60) -> tuple[DataFrame, DataFrame]:
    """(author, papers) of the authors with the most papers, and (left, right, shared) among them.

    Only kept authors enter the self-join, so a paper contributes pairs of at
    most `limit` authors.
    """
    nodes = authors.groupBy("author").agg(F.countDistinct("paper_id").alias("weight")).orderBy(F.desc("weight"), "author").limit(limit)
    kept = authors.join(F.broadcast(nodes.select("author")), "author", "left_semi").distinct()
    left, right = kept.withColumnRenamed("author", "left"), kept.withColumnRenamed("author", "right")
    edges = left.join(right, "paper_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("weight"))
    return nodes, edges


def citation_edges(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(src_paper, dst_paper) where a reference's normalised title is a paper's; of equal titles the larger id is meant."""
    titled = papers.select(F.col("paper_id").alias("dst_paper"), tx.normalize_key("title").alias("title_key")).where("title_key <> ''").groupBy("title_key").agg(F.max("dst_paper").alias("dst_paper"))
    cited = references.select(F.col("paper_id").alias("src_paper"), tx.normalize_key("title").alias("title_key"))
    return cited.join(titled, "title_key").where("src_paper <> dst_paper").select("src_paper", "dst_paper").distinct()


def citation_nodes(citations: DataFrame, papers: DataFrame, limit: int = 80) -> DataFrame:
    """paper_id, weight (citations received + 1): the most cited first."""
    received = citations.groupBy(F.col("dst_paper").alias("paper_id")).agg(F.count("*").alias("n"))
    return papers.select("paper_id").join(received, "paper_id", "left").select("paper_id", (F.coalesce("n", F.lit(0)) + 1).alias("weight")).orderBy(F.desc("weight"), "paper_id").limit(limit)


def entity_network(entities: DataFrame, min_papers: int = 2, limit: int = 60, labels: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(label, key, name, weight) shared by at least min_papers papers, and their (label, key, paper_id) mentions."""
    scoped = entities.where(F.col("label").isin(*labels)) if labels else entities
    nodes = scoped.groupBy("label", "key").agg(F.min("name").alias("name"), F.countDistinct("paper_id").alias("weight")).where(F.col("weight") >= min_papers).orderBy(F.desc("weight"), "label", "key").limit(limit)
    mentions = scoped.join(F.broadcast(nodes.select("label", "key")), ["label", "key"], "left_semi").select("label", "key", "paper_id").distinct()
    return nodes, mentions


def cooccurrence(entities: DataFrame, limit: int = 25, label: str | None = None) -> DataFrame:
    scoped = entities if label is None else entities.where(F.col("label") == label)
    return scoped.groupBy("label", "name").agg(F.countDistinct("paper_id").alias("n_papers")).orderBy(F.desc("n_papers"), "label", "name").limit(limit)


def most_connected(entities: DataFrame, papers: DataFrame, limit: int = 10) -> DataFrame:
    """paper_id, title, n_keys: papers with the most distinct keys, whatever their labels."""
    top = entities.groupBy("paper_id").agg(F.countDistinct("key").alias("n_keys")).orderBy(F.desc("n_keys"), "paper_id").limit(limit)
    return papers.select("paper_id", "title").join(F.broadcast(top), "paper_id")


def seeds(entities: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(label, key) of entities that the words of a question, or known terms in it, name."""
    words = {w for w in re.sub(r"[.,;:()\[\]{}\"']", " ", query.lower()).split() if len(w) >= 3}
    lower = query.lower()
    terms = {t for group in lx.ENTITY_TERMS.values() for t in group if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", lower)}
    hits = entities.where(F.col("key").isin(*sorted(words | terms)))
    return hits.groupBy("label", "key").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "label", "key").limit(limit)


def expand(entities: DataFrame, seed: DataFrame, exclude: Sequence = (), limit: int = 12) -> DataFrame:
    """Papers that share seeds: paper_id, strength.  Each seed offers its first `limit` papers before any are excluded."""
    shared = entities.join(seed.select("label", "key").distinct(), ["label", "key"]).select("label", "key", "paper_id").distinct()
    offered = shared.withColumn("n", F.row_number().over(Window.partitionBy("label", "key").orderBy("paper_id"))).where(F.col("n") <= limit)
    kept = offered.where(~F.col("paper_id").isin(*exclude)) if exclude else offered
    return kept.groupBy("paper_id").agg(F.count("*").alias("strength")).orderBy(F.desc("strength"), "paper_id").limit(limit)


def resolve_relations(relations: DataFrame, papers: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (paper_id, type, source, target: names) as edges: a name is a paper's title or an entity of that paper; others are dropped."""
    titles = papers.select(tx.normalize_key("title").alias("name_key"), F.concat(F.lit("Paper:"), F.col("paper_id").cast("string")).alias("uid")).groupBy("name_key").agg(F.max("uid").alias("title_uid"))
    own = entities.groupBy("paper_id", F.col("key").alias("name_key")).agg(F.min(F.concat("label", F.lit(":"), "key")).alias("entity_uid"))

    def end(rows: DataFrame, name: str, out: str) -> DataFrame:
        keyed = rows.withColumn("name_key", tx.normalize_key(name))
        return keyed.join(titles, "name_key", "left").join(own, ["paper_id", "name_key"], "left").withColumn(out, F.coalesce("title_uid", "entity_uid")).drop("name_key", "title_uid", "entity_uid")

    both = end(end(relations, "source", "src"), "target", "dst")
    return legal(both.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "type", "dst")).distinct()


def build_papers(papers: DataFrame, mentions: DataFrame, references: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of whole papers: authors, venue, mentioned entities, stated relations and citations.

    papers: paper_id, title, authors (one string), venue; mentions: paper_id,
    label, name; references: paper_id, title; relations: paper_id, type,
    source, target.  Edges that the schema does not allow are dropped, and
    every end of an edge is a node; so is each paper and entity by itself.
    """
    uid = F.concat(F.lit("Paper:"), F.col("paper_id").cast("string"))
    named = mentions.select("paper_id", "label", tx.normalize_key("name").alias("key")).where("key <> ''").distinct()
    kind = F.create_map(*(F.lit(x) for pair in lx.RELATION_OF_LABEL.items() for x in pair))[F.col("label")]
    parts = [
        papers.select(uid.alias("src"), F.explode(tx.authors("authors")).alias("author")).select("src", F.lit("AUTHORED_BY").alias("type"), F.concat(F.lit("Author:"), tx.normalize_key("author")).alias("dst")),
        papers.where("venue <> ''").select(uid.alias("src"), F.lit("PUBLISHED_IN").alias("type"), F.concat(F.lit("Venue:"), tx.normalize_key("venue")).alias("dst")),
        named.select(uid.alias("src"), kind.alias("type"), F.concat("label", F.lit(":"), "key").alias("dst")),
        citation_edges(references, papers).select(F.concat(F.lit("Paper:"), F.col("src_paper").cast("string")).alias("src"), F.lit("CITES").alias("type"), F.concat(F.lit("Paper:"), F.col("dst_paper").cast("string")).alias("dst")),
    ]
    if relations is not None:
        parts.append(resolve_relations(relations, papers, named))
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    edges = legal(edges).distinct()
    alone = papers.select(uid.alias("uid")).unionByName(named.select(F.concat("label", F.lit(":"), "key").alias("uid")))
    nodes = nodes_of(edges).unionByName(alone.select("uid", label_of("uid").alias("label"))).distinct()
    return nodes, edges

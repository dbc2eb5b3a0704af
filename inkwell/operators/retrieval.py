"""Keyword, vector and hybrid retrieval as DataFrame plans.

A query's terms and vector are literals in the plan.  Scoring is a projection
over the rows that pass the filters, followed by a top-k; only ids, scores and
ranks travel until the last step, which fetches texts of the hits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx


@dataclass(frozen=True)
class Filters:
    """A retrieval filter; an empty part does not restrict.  Values are matched exactly, sections as substrings."""

    paper_ids: tuple = ()
    kinds: tuple = ()
    year_from: int | None = None
    year_to: int | None = None
    sections: tuple[str, ...] = ()
    equals: dict = field(default_factory=dict)

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.paper_ids:
            out &= F.col("paper_id").isin(*self.paper_ids)
        if self.kinds:
            out &= F.col("kind").isin(*self.kinds)
        if self.year_from is not None:
            out &= F.col("published_year") >= self.year_from
        if self.year_to is not None:
            out &= F.col("published_year") <= self.year_to
        if self.sections:
            path = F.lower(F.coalesce("section_path", F.lit("")))
            out &= F.exists(tx.strings([s.lower() for s in self.sections]), lambda s: path.contains(s))
        for name, value in self.equals.items():
            many = isinstance(value, list | tuple | set)
            out &= F.coalesce(F.col(name).isin(*value) if many else F.col(name) == F.lit(value), F.lit(False))
        return out


def query_terms(query: str, stopwords: Sequence[str] = lx.SEARCH_STOPWORDS) -> list[str]:
    return [t for t in re.findall(tx.TOKEN, query.lower()) if len(t) > 1 and t not in stopwords]


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents, of tokens, and tokens per document."""
    size = F.size(tx.tokens(F.coalesce(F.col(text), F.lit(""))))  # a document without text has no tokens
    return docs.agg(F.count("*").alias("n_docs"), F.sum(size).cast("long").alias("n_tokens"), F.round(F.avg(size), 6).alias("avg_tokens"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tx.tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df: the distinct terms of each document are counted, so no document id is shuffled."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def merge_frequencies(index: DataFrame, added: DataFrame, removed: DataFrame | None = None, text: str = "text") -> DataFrame:
    """document_frequencies after adding and removing documents: signed counts, terms of no document dropped."""
    change = document_frequencies(added, text)
    if removed is not None:
        change = change.unionByName(document_frequencies(removed, text).withColumn("df", -F.col("df")))
    return index.unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def bm25(docs: DataFrame, query: str, limit: int = 10, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """key, score, rank of the best documents.  Statistics are over all of docs; where restricts candidates only.

    Scores have twelve decimals, so that equal ones are equal in whatever order
    their parts are added.
    """
    terms = Counter(query_terms(query))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    counted = docs.withColumn("__tokens", tx.tokens(F.coalesce(F.col(text), F.lit(""))))
    tf = {t: _tf(t) for t in terms}
    stats = counted.agg(F.count("*").alias("n"), F.avg(F.size("__tokens")).alias("avg"), *(F.count_if(F.array_contains("__tokens", t)).alias(f"df{i}") for i, t in enumerate(terms)))
    matching = counted if where is None else counted.where(where)
    # One row of statistics: a broadcast of fixed size.
    scored = matching.where(F.arrays_overlap("__tokens", tx.strings(list(terms)))).crossJoin(F.broadcast(stats))
    length = lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * F.size("__tokens") / F.col("avg"))
    score = F.lit(0.0)
    for i, (term, times) in enumerate(terms.items()):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += times * idf * tf[term] * (lx.BM25_K1 + 1) / (tf[term] + length)
    return ranked(scored.select(key, F.round(score, 12).alias("score")).where("score > 0"), key, limit)


def exact_sum(part: Column) -> Column:
    """The sum of parts of 0 or more that does not depend on their order, as sums of doubles do.

    A part is dealt into units of 2**-20 and the rest of it in units of 2**-60;
    both are added as integers, so equal parts give equal sums and ties stay ties.
    """
    units = part * F.lit(float(1 << 20))
    whole = F.floor(units)
    rest = F.rint((units - whole) * F.lit(float(1 << 40))).cast("long")
    return (F.sum(whole) + F.sum(rest) / F.lit(float(1 << 40))) / F.lit(float(1 << 20))


def _tf(term: str) -> Column:
    return F.size(F.filter("__tokens", lambda x: x == F.lit(term)))


def ranked(scores: DataFrame, key: str, limit: int, name: str = "rank") -> DataFrame:
    """The `limit` best rows with their ranks; the window runs over those few rows only."""
    best = scores.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), key)))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def dense(vectors: DataFrame, query: Sequence[float], limit: int = 10, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """key, score, rank by dot product; a vector of another length is an error, as a silent skip would hide bad data."""
    matching = vectors if where is None else vectors.where(where)
    literal = F.array(*(F.lit(float(x)) for x in query))
    same = F.when(F.size(vector) == len(query), dot(F.col(vector), literal)).otherwise(F.raise_error(F.lit("vector lengths differ")).cast("double"))
    return ranked(matching.select(key, same.alias("score")), key, limit)


def hash_embedding(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 384) -> DataFrame:
    """key, bucket, weight: signed counts of hashed words, scaled to length 1; made row by row in Arrow batches, without a shuffle."""
    lowered = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    kind = lowered.schema["key"].dataType.simpleString()
    rows = lowered.mapInArrow(_hashed(dim), f"key {kind}, bucket long, w long, squares long")
    return rows.select(F.col("key").alias(key), "bucket", F.round(F.col("w") / F.sqrt("squares"), 6).alias("weight"))


_places: dict[str, tuple[int, int]] = {}


def _place(word: str) -> tuple[int, int]:
    """(number of 32 bits, sign) of a word; a bounded number of words is remembered."""
    found = _places.get(word)
    if found is None:
        if len(_places) > 500_000:
            _places.clear()
        h = hashlib.sha256(word.encode()).digest()
        found = _places[word] = int.from_bytes(h[:4], "big"), 1 - 2 * (h[4] % 2)
    return found


def _hashed(dim: int):
    words = re.compile("[^ \t\n\v\f\r]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, buckets, weights, squares = [], [], [], []
            for row, low in enumerate(batch.column("low").to_pylist()):
                sums: Counter = Counter()
                for word, n in Counter(words(low or "")).items():
                    number, sign = _place(word)
                    sums[number % dim] += sign * n
                some = [(b, w) for b, w in sums.items() if w]
                at += [row] * len(some)
                buckets += [b for b, _ in some]
                weights += [w for _, w in some]
                squares += [sum(w * w for _, w in some)] * len(some)
            columns = [batch.column("key").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (buckets, weights, squares))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "bucket", "w", "squares"])

    return run


def hash_vectors(docs: DataFrame, text: str = "text", dim: int = 384, name: str = "vector") -> DataFrame:
    """docs with the whole embedding of a text as an array; a text without words has a vector of zeros."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([hash_vector(low or "", dim) for low in batch.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` array<double>")


def hash_vector(query: str, dim: int = 384) -> list[float]:
    """The same embedding of one query string."""
    out = [0.0] * dim
    for word in query.lower().split():
        number, sign = _place(word)
        out[number % dim] += sign
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, key: str, limit: int = 10, k: int = lx.FUSION_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion: key, score, dense_rank, sparse_rank, rank.  Ties: found by both first, then key."""
    both = dense_hits.select(key, F.col("rank").alias("dense_rank")).join(sparse_hits.select(key, F.col("rank").alias("sparse_rank")), key, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    score = part(weights[0], "dense_rank") + part(weights[1], "sparse_rank")
    order = [F.desc("score"), F.desc((F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()).cast("int")), F.col(key)]
    best = both.withColumn("score", score).orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(candidates: DataFrame, query: str, key: str = "doc_id", text: str = "text", phrase_bonus: float = lx.PHRASE_BONUS, most: int = lx.CANDIDATE_CAP) -> DataFrame:
    """The `most` best candidates (key, text, score, rank) plus rerank_score and new_rank.

    Query terms weigh the inverse of how many candidates hold them; a query
    that stands in a text word for word adds the bonus.  An empty query keeps
    the given scores.  Twelve decimals, so that different terms of the same
    weight tie, and the rank before decides.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    candidates = candidates.orderBy("rank", key).limit(most)  # so the windows over all of them are bounded
    every = Window.partitionBy(F.lit(0))
    if terms:
        counted = candidates.withColumn("__tokens", tx.tokens(text))
        has = [F.array_contains("__tokens", t).cast("int") for t in terms]
        weights = [1.0 / F.greatest(F.sum(h).over(every), F.lit(1)) for h in has]
        total = sum(weights[1:], weights[0])
        matched = sum((w * h for w, h in zip(weights[1:], has[1:], strict=True)), weights[0] * has[0])
        phrase = F.array_join("__tokens", " ").contains(" ".join(query_terms(query)))
        scored = counted.withColumn("rerank_score", F.round(matched / total + F.when(phrase, phrase_bonus).otherwise(0.0), 12)).drop("__tokens")
    else:
        scored = candidates.withColumn("rerank_score", F.col("score"))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rerank_score"), "rank", key)))


def candidates(limit: int) -> int:
    """How many hits of each retriever are fused for `limit` results."""
    return min(lx.CANDIDATE_CAP, max(lx.CANDIDATE_FACTOR * limit, limit))


def finished(docs: DataFrame, dense_hits: DataFrame, sparse_hits: DataFrame, query: str, limit: int, key: str, text: str) -> DataFrame:
    """The hits of both retrievers fused, texts fetched, reranked, with supporting sentences."""
    wide = candidates(limit)
    fused = fuse(dense_hits, sparse_hits, key, wide)
    hits = docs.join(F.broadcast(fused), key)  # `wide` rows at most
    best = rerank(hits, query, key, text).where(F.col("new_rank") <= limit)
    return best.withColumn("supporting", tx.supporting(tx.strings(list(dict.fromkeys(query_terms(query)))), F.col(text)))


def retrieve(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int = 10, key: str = "doc_id", text: str = "text", filters: Filters | None = None) -> DataFrame:
    """Both retrievers by scans of docs and vectors (search.retrieve() asks kept indexes); a blank query finds nothing."""
    if not query.strip():
        return docs.select(key).limit(0)
    wide = candidates(limit)
    where = None if filters is None else filters.predicate()
    sparse = bm25(docs, query, wide, key, text, where)
    scoped = vectors if where is None else vectors.join(docs.where(where).select(key), key, "left_semi")
    return finished(docs, dense(scoped, query_vector, wide, key), sparse, query, limit, key, text)


def pack_context(ranked_chunks: DataFrame, query: str, max_tokens: int, reserved: int = 1200, group: str = "query_id", order: str = "rank", text: str = "text") -> DataFrame:
    """Fits each query's ranked chunks into a token budget: group, order, action (kept / compressed / dropped), content.

    A chunk that fits is kept; one that does not is cut to its supporting
    sentences while at least 40 tokens are left.  A fold over each query's few
    ranked chunks; queries are independent rows.
    """
    terms = tx.strings(list(dict.fromkeys(query_terms(query))))
    need = lambda s: F.greatest(F.lit(1), F.floor(F.length(s) / 4).cast("int"))
    listed = ranked_chunks.withColumn("__short", tx.supporting(terms, F.col(text), 6)).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("body"), F.col("__short").alias("short")))).alias("list"))
    row = "array<struct<at:int,action:string,content:string,tokens:int>>"
    some = lambda left, c: F.aggregate(
        c["short"],
        F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept")),
        lambda a, s: F.when(a["full"] | (a["used"] + need(s) > left), F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["kept"].alias("kept"))).otherwise(
            F.struct((a["used"] + need(s)).alias("used"), F.lit(False).alias("full"), F.array_append(a["kept"], s).alias("kept"))
        ),
    )

    def step(acc, c):
        left = acc["left"]
        cut = some(left, c)
        keep = need(c["body"]) <= left
        compress = ~keep & (left >= 40) & (F.size(cut["kept"]) > 0)
        used = F.when(keep, need(c["body"])).when(compress, cut["used"]).otherwise(0)
        content = F.when(keep, c["body"]).when(compress, F.array_join(cut["kept"], " ")).otherwise("")
        action = F.when(keep, "kept").when(compress, "compressed").otherwise("dropped")
        entry = F.struct(c["at"].cast("int").alias("at"), action.alias("action"), content.alias("content"), used.cast("int").alias("tokens"))
        return F.struct((left - used).cast("int").alias("left"), F.array_append(acc["out"], entry).alias("out"))

    budget = max(0, max_tokens - reserved)
    folded = F.aggregate("list", F.struct(F.lit(budget).alias("left"), F.array().cast(row).alias("out")), step, lambda a: a["out"])
    return listed.select(group, F.inline(folded))

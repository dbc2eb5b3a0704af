"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

import math

from inkwell.functions import lexicons as lx
from inkwell.operators.retrieval import query_terms
from inkwell.plans.catalogue import MARKERS, QUESTION, TERMS

VIEWS = {
    "papers": """SELECT o_orderkey AS paper_id, c_nationkey AS workspace_id, 'Paper ' || o_orderkey AS title,
        CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready' ELSE 'pending' END AS status,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS published_year, o_orderpriority AS venue
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "results": """SELECT l_orderkey AS paper_id, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, lower(s_name) AS model_key,
        CASE WHEN l_linenumber % 7 <> 0 THEN lower(p_brand) END AS dataset_key,
        CASE l_returnflag WHEN 'A' THEN 'accuracy' WHEN 'N' THEN 'f1' ELSE 'perplexity' END AS metric_key, l_quantity AS value,
        CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS good
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "entities": """SELECT paper_id, label, lower(name) AS key, min(name) AS name, max(confidence) AS confidence FROM (
        SELECT l_orderkey AS paper_id, 'Dataset' AS label, p_brand AS name, 1 - l_discount AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL
        SELECT l_orderkey, 'Task', p_type, 1 - l_discount FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL
        SELECT l_orderkey, 'Metric', CASE l_returnflag WHEN 'A' THEN 'accuracy' WHEN 'N' THEN 'f1' ELSE 'perplexity' END, 1 - l_discount FROM lineitem JOIN part ON l_partkey = p_partkey)
        GROUP BY paper_id, label, lower(name)""",
    "authors": "SELECT DISTINCT l_orderkey AS paper_id, s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "citations": "SELECT DISTINCT l_orderkey AS src_paper, l_partkey AS dst_paper FROM lineitem WHERE l_orderkey <> l_partkey AND l_partkey IN (SELECT paper_id FROM papers)",
    "edges": """SELECT 'Paper:' || paper_id AS src, 'AUTHORED_BY' AS type, 'Author:' || lower(author) AS dst FROM authors UNION ALL
        SELECT 'Paper:' || paper_id, CASE label WHEN 'Dataset' THEN 'USES_DATASET' WHEN 'Task' THEN 'ADDRESSES' ELSE 'REPORTS' END, label || ':' || key FROM entities UNION ALL
        SELECT 'Paper:' || paper_id, 'PUBLISHED_IN', 'Venue:' || lower(venue) FROM papers UNION ALL
        SELECT 'Paper:' || src_paper, 'CITES', 'Paper:' || dst_paper FROM citations""",
    "nodes": "SELECT DISTINCT uid, split_part(uid, ':', 1) AS label FROM (SELECT src AS uid FROM edges UNION ALL SELECT dst FROM edges)",
    "chunks": """SELECT paper_id, chunk_index, content, CASE WHEN contains(content, '|') THEN 'table' ELSE 'text' END AS kind FROM (
        SELECT doc_id AS paper_id, CAST(unnest(range(len(l))) AS INTEGER) AS chunk_index, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
}
_NEEDS = {"citations": ["papers"], "edges": ["papers", "authors", "citations", "entities"], "nodes": ["papers", "authors", "citations", "entities", "edges"]}


def sql(body: str, *views: str, extra: str = "", recursive: bool = False) -> str:
    """body after the views it needs; extra: more common table expressions."""
    wanted = {x for view in views for x in (*_NEEDS.get(view, []), view)}
    parts = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in wanted]
    if extra:
        parts.append(extra)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quote, words)) + "]"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\-_.]*'), lambda t: length(t) > 1 AND NOT list_contains({listed(lx.SEARCH_STOPWORDS)}, t))"


def terms(text: str) -> str:
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9\-_.]*'), lambda w: trim(w, '.-_')), lambda t: length(t) >= 3 AND NOT list_contains({listed(lx.JUDGE_STOPWORDS)}, t)))"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def cut(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace({text}, '([.!?])', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')"


def bm25(query: str, limit: int, where: str = "true", key: str = "doc_id") -> str:
    words = query_terms(query)
    rows = ", ".join(f"({quote(t)}, {words.count(t)})" for t in dict.fromkeys(words))
    return f"""SELECT *, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM (
      SELECT {key}, round(sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))), 12) AS score FROM (
        SELECT d.{key}, q.term, q.times, len(list_filter(tok, lambda t: t = q.term)) AS tf, len(tok) AS dl FROM tk d, (VALUES {rows}) q(term, times) WHERE {where}) c
      JOIN (SELECT term, count(*) FILTER (WHERE list_contains(tok, term)) AS df FROM tk, (VALUES {rows}) v(term, times) GROUP BY term) f ON c.term = f.term
      JOIN (VALUES {rows}) q(term, times) ON q.term = c.term
      CROSS JOIN (SELECT count(*) AS n, avg(len(tok)) AS avg FROM tk) s WHERE tf > 0 GROUP BY {key}) ORDER BY score DESC, {key} LIMIT {limit}"""


TK = f"tk AS MATERIALIZED (SELECT *, {tokens('text')} AS tok FROM documents)"


def dense(limit: int, where: str = "true", key: str = "vec_id") -> str:
    return f"""SELECT vec_id AS {key}, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}) ORDER BY score DESC, vec_id LIMIT {limit}"""


def fused(wide: int, limit: int, docs: str = "true", vectors: str = "true") -> str:
    return f"""s AS ({bm25(QUESTION, wide, docs)}), v AS ({dense(wide, vectors, key="doc_id")}),
    f AS (SELECT coalesce(s.doc_id, v.doc_id) AS doc_id, v.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score
      FROM v FULL JOIN s ON s.doc_id = v.doc_id),
    g AS (SELECT *, row_number() OVER (ORDER BY score DESC, CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 1 ELSE 0 END DESC, doc_id) AS rank FROM f ORDER BY rank LIMIT {limit})"""


def reranked(hits: str) -> str:
    q = list(dict.fromkeys(query_terms(QUESTION)))
    return f"""c AS (SELECT {hits}.doc_id, score, rank, tok, text FROM {hits} JOIN tk USING (doc_id)),
    w AS (SELECT term, 1.0::DOUBLE / greatest(1, count(*) FILTER (WHERE list_contains(tok, term))) AS weight FROM c, (SELECT unnest({listed(q)}) AS term) GROUP BY term),
    r AS (SELECT doc_id, score, rank, text, sum(CASE WHEN list_contains(tok, term) THEN weight ELSE 0 END) / sum(weight)
      + CASE WHEN contains(array_to_string(any_value(tok), ' '), {quote(' '.join(query_terms(QUESTION)))}) THEN 0.5 ELSE 0 END AS rerank_score FROM c, w GROUP BY doc_id, score, rank, text),
    n AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rank, doc_id) AS new_rank FROM r)"""


def supporting(text: str, limit: int = 3) -> str:
    q = listed(query_terms(QUESTION))
    scored = f"list_transform({sentences(text)}, lambda s, i: {{'score': -len(list_intersect({q}, {tokens('s')})), 'at': i, 'sentence': s}})"
    return f"list_sort(list_filter({scored}, lambda z: z.score < 0 AND length(z.sentence) >= 20))[1:{limit}]"


CELLS = """SELECT dataset_key, metric_key, paper_id, model_key, value, k1, k2, k3, k4, good,
    row_number() OVER (PARTITION BY dataset_key, metric_key ORDER BY good DESC, k1, k2, k3, k4) AS rank,
    CASE WHEN count(*) OVER g > 1 THEN max(value) OVER g - min(value) OVER g ELSE 0 END AS spread, count(*) OVER g AS n_cells
    FROM results WHERE dataset_key IS NOT NULL{more} WINDOW g AS (PARTITION BY dataset_key, metric_key)"""


def comparison(more: str, least: int) -> str:
    return sql(
        f"""SELECT dataset_key, metric_key, paper_id, model_key, value, rank, rank = 1 AS is_best, spread, n_cells, n_papers FROM c
        JOIN (SELECT dataset_key, metric_key, count(DISTINCT paper_id) AS n_papers FROM c GROUP BY ALL) USING (dataset_key, metric_key) WHERE n_papers >= {least}""",
        "results",
        extra=f"c AS ({CELLS.format(more=more)})",
    )


def comparison_rows(least: int, columns: str) -> str:
    return sql(
        f"""SELECT {columns} FROM (SELECT dataset_key, metric_key, count(*) AS n_cells, count(DISTINCT paper_id) AS n_papers, max(value) - min(value) AS spread,
        max(model_key) FILTER (WHERE rank = 1) AS best_model, max(value) FILTER (WHERE rank = 1) AS best_value FROM c GROUP BY ALL) WHERE n_papers >= {least}""",
        "results",
        extra=f"c AS ({CELLS.format(more='')})",
    )


TREND = """y AS (SELECT label, name, published_year, count(DISTINCT paper_id) AS n FROM dated GROUP BY ALL),
 z AS (SELECT *, row_number() OVER (PARTITION BY label, name ORDER BY published_year DESC) <= 2 AS recent FROM y),
 t AS (SELECT label, name, CAST(sum(n) AS BIGINT) AS total, min(published_year) AS first_year, count(*) AS years, coalesce(sum(n) FILTER (WHERE recent), 0) AS late, coalesce(sum(n) FILTER (WHERE NOT recent), 0) AS early FROM z GROUP BY label, name)"""
TREND_OUT = """SELECT label, name, total, first_year, CASE WHEN years < 2 THEN 'new' WHEN early = 0 THEN 'emerging' WHEN late / early >= 1.5 THEN 'rising' WHEN late / early <= 0.5 THEN 'declining' ELSE 'steady' END AS direction
 FROM t ORDER BY total DESC, label, name LIMIT {n}"""
CONFLICTS = """last AS (SELECT model_key, dataset_key, metric_key, paper_id, arg_max(value, (k1, k2, k3, k4, value)) AS value FROM results WHERE dataset_key IS NOT NULL GROUP BY ALL),
 conflicts AS (SELECT l.model_key, l.dataset_key, l.metric_key, l.paper_id AS left_paper, l.value AS left_value, r.paper_id AS right_paper, r.value AS right_value,
   round(abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9), 6) AS gap FROM last l JOIN last r USING (model_key, dataset_key, metric_key)
   WHERE l.paper_id < r.paper_id AND abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9) >= 0.05)"""
COVERAGE = """scope AS (SELECT DISTINCT paper_id FROM papers), total AS (SELECT count(*) AS n FROM scope),
 cov AS (SELECT label, name, count(DISTINCT paper_id) AS covered FROM entities WHERE label IN ('Task', 'Metric') AND paper_id IN (SELECT paper_id FROM scope) GROUP BY ALL),
 topc AS (SELECT label, name, covered, covered / n AS ratio FROM cov, total WHERE n >= 3 AND covered / n >= 0.4 AND covered / n < 1 ORDER BY ratio DESC, label, name LIMIT 12),
 lack AS (SELECT t.label, t.name, list_sort(list(s.paper_id))[1:5] AS ids FROM topc t, scope s WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.label = t.label AND e.name = t.name AND e.paper_id = s.paper_id) GROUP BY t.label, t.name),
 coverage AS (SELECT label, name, covered, round(ratio, 6) AS ratio, array_to_string(ids, ',') AS missing FROM topc JOIN lack USING (label, name))"""
#: Over all papers, with brand and type as the dataset.
EVALUATION = """tested AS (SELECT DISTINCT model_key, dataset_key || ' / ' || lower(p_type) AS dataset_key FROM results JOIN part ON k3 = p_partkey WHERE dataset_key IS NOT NULL),
 ds AS (SELECT DISTINCT dataset_key FROM tested), ms AS (SELECT DISTINCT model_key FROM tested),
 un AS (SELECT model_key, list_sort(list(dataset_key)) AS lack FROM (SELECT model_key, dataset_key FROM ms, ds EXCEPT SELECT * FROM tested) GROUP BY model_key),
 evaluation AS (SELECT model_key, len(lack) AS untested, round(1 - len(lack) / (SELECT count(*) FROM ds), 6) AS strength, array_to_string(lack[1:5], ',') AS missing
   FROM un WHERE (SELECT count(*) FROM ds) >= 2 AND (SELECT count(*) FROM ms) >= 2 AND len(lack) < (SELECT count(*) FROM ds) ORDER BY strength DESC, model_key LIMIT 12)"""
CLAIMS = rf"""cl AS (SELECT paper_id, claim_no, claim FROM (
   SELECT paper_id, claim, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, pos) AS claim_no FROM (
     SELECT paper_id, chunk_index, unnest(range(len(c))) AS pos, unnest(c) AS claim FROM (
       SELECT paper_id, chunk_index, list_filter(list_transform({cut('content')}, lambda s: trim(s)), lambda s: length(s) BETWEEN 60 AND 600 AND ({' OR '.join(f"contains(lower(s), {quote(m)})" for m in MARKERS)}))[1:6] AS c
       FROM chunks WHERE chunk_index < 30))) WHERE claim_no <= 6)"""
AUTHORS = """an AS (SELECT author, count(DISTINCT paper_id) AS weight FROM authors GROUP BY author ORDER BY weight DESC, author LIMIT 60)"""
ENTITY_TOP = """en AS (SELECT label, key, min(name) AS name, count(DISTINCT paper_id) AS weight FROM entities GROUP BY label, key HAVING count(DISTINCT paper_id) >= 2 ORDER BY weight DESC, label, key LIMIT 60)"""
SEED_WORDS = ("accuracy", "and", "brand#11", "brand#12", "brand#33", "f1")
SEEDS = f"sd AS (SELECT label, key, max(confidence) AS confidence FROM entities WHERE key IN ({', '.join(map(quote, SEED_WORDS))}) GROUP BY label, key ORDER BY confidence DESC, label, key LIMIT 8)"


def neighbors(depth: int, types: tuple[str, ...]) -> str:
    where = f"WHERE type IN ({', '.join(map(quote, types))})" if types else ""
    hops = [f"st AS (SELECT src AS a, dst AS b, 'out' AS direction FROM edges {where} UNION ALL SELECT dst, src, 'in' FROM edges {where})", "h1 AS (SELECT b AS uid, max(direction) AS direction, 1 AS distance FROM st WHERE a = 'Paper:1' AND b <> 'Paper:1' GROUP BY b)"]
    for n in range(2, depth + 1):
        seen = " UNION ALL ".join(f"SELECT uid FROM h{k}" for k in range(1, n))
        hops.append(f"h{n} AS (SELECT b AS uid, max(st.direction) AS direction, {n} AS distance FROM st JOIN h{n - 1} ON a = uid WHERE b <> 'Paper:1' AND b NOT IN ({seen}) GROUP BY b)")
    return sql(" UNION ALL ".join(f"SELECT uid, direction, distance FROM h{n}" for n in range(1, depth + 1)), "edges", extra=", ".join(hops))


def counts(nodes: str, edges: str) -> str:
    return f"SELECT label, count(*) AS n FROM {nodes} GROUP BY label UNION ALL SELECT '_relationships', count(*) FROM {edges}"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def share(flags: str) -> str:
    return f"CASE WHEN len({flags}) = 0 THEN 0.0 ELSE list_sum(list_transform({flags}, lambda x: CASE WHEN x THEN 1.0::DOUBLE ELSE 0.0 END)) / len({flags}) END"


JUDGED = rf"""qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
 cx AS (SELECT qa.conv_id, qa.turn, list(c.text ORDER BY c.turn, c.text) AS contexts FROM qa JOIN conversations c ON c.conv_id = qa.conv_id AND c.turn < qa.turn AND c.role IN ('user', 'assistant', 'system') GROUP BY ALL),
 tt AS (SELECT qa.*, coalesce(contexts, []) AS contexts, {terms('question')} AS q, {terms('answer')} AS a, {terms("array_to_string(coalesce(contexts, []), ' ')")} AS whole,
   list_transform(coalesce(contexts, []), lambda c: {terms('c')}) AS per, list_transform({sentences("coalesce(answer, '')")}, lambda s: {terms('s')}) AS said,
   list_distinct(regexp_extract_all(coalesce(answer, ''), '\[(\d+)\]', 1)) AS marks,
   list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{{1,2}})\]', 1), lambda x: CAST(x AS INTEGER)), lambda i: i BETWEEN 1 AND 3)) AS cited,
   coalesce(trim(question), '') = '' AS blank FROM qa LEFT JOIN cx USING (conv_id, turn)),
 ms AS (SELECT conv_id, turn, question, answer,
   round(CASE WHEN len(contexts) = 0 THEN 0.0 ELSE {share(f"list_transform(said, lambda s: ({overlap('s', 'whole')}) >= 0.3)")} END, 4) AS faithfulness,
   round(CASE WHEN len(q) = 0 THEN 0.0 ELSE {overlap('q', 'a')} END, 4) AS answer_relevancy,
   round({share(f"list_transform(per, lambda c: ({overlap('q', 'c')}) >= 0.3 OR (NOT blank AND ({overlap('q', 'c')}) >= 0.3))")}, 4) AS context_precision,
   round(CASE WHEN blank THEN 1.0 ELSE {overlap('q', 'whole')} END, 4) AS context_recall,
   round(CASE WHEN len(marks) = 0 THEN 0.0 ELSE len(cited)::DOUBLE / len(marks) END, 4) AS citation_validity FROM tt),
 sc AS (SELECT *, round((faithfulness + answer_relevancy + context_precision + context_recall + citation_validity) / 5, 4) AS overall FROM ms)"""
GATED = f"""ga AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN CASE WHEN {' OR '.join(f"contains(lower(answer), {quote(m)})" for m in lx.REFUSAL_MARKERS)} THEN '' ELSE 'should have refused' END
   ELSE array_to_string(list_filter([CASE WHEN faithfulness < 0.6 THEN 'faithfulness' END, CASE WHEN context_precision < 0.3 THEN 'context_precision' END, CASE WHEN citation_validity < 0 THEN 'citation_validity' END], lambda x: x IS NOT NULL), ',') END AS failures FROM sc)"""

HTML = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
SNIPPET = rf"trim(regexp_replace(regexp_replace({HTML}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), '\s+', ' ', 'g'))"


def _first_match(text: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(left(regexp_extract({text}, {quote('(?i)(' + p + ')')}, 1), 60), '')" for p in patterns) + ")"


def _gaz(terms_by_label: dict, out: str) -> str:
    rows = ", ".join(f"({quote(label)}, {quote(t)}, {quote('(^|[^A-Za-z0-9_])(' + _escape(t) + ')([^A-Za-z0-9_]|$)')})" for label, ts in terms_by_label.items() for t in ts)
    at = "length(regexp_extract(low, '(?s)^(.*?)' || pattern, 1)) + length(regexp_extract(low, pattern, 1)) + 1"
    return rf"""WITH l AS (SELECT doc_id, text AS t, lower(text) AS low FROM documents), g(label, name, pattern) AS (VALUES {rows}),
h AS (SELECT doc_id, label, name, t, {at} AS pos FROM l, g WHERE contains(low, name) AND regexp_matches(low, pattern)) {out}"""


def _escape(x: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in x)


_ROUNDED = "SELECT * REPLACE (round(score, 6) AS score) FROM"
_QUANT = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in (0.5, 0.95, 0.99))

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def _bucket_quantile(p: float) -> str:
    """Interpolated within the first bucket whose cumulative count reaches the rank."""
    return f"""(SELECT round(CASE WHEN count(*) FILTER (WHERE c.n >= {p} * t.n) = 0 THEN {BOUNDS[-1]} ELSE
      coalesce(max(c.le) FILTER (WHERE c.n < {p} * t.n), 0) + (min(c.le) FILTER (WHERE c.n >= {p} * t.n) - coalesce(max(c.le) FILTER (WHERE c.n < {p} * t.n), 0))
      * ({p} * t.n - coalesce(max(c.n) FILTER (WHERE c.n < {p} * t.n), 0)) / (min(c.n) FILTER (WHERE c.n >= {p} * t.n) - coalesce(max(c.n) FILTER (WHERE c.n < {p} * t.n), 0)) END, 6)
      FROM c WHERE c.route = t.route) AS p{round(100 * p)}"""


ORACLES = {
    "tokenize_terms": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "content_term_sets": f"SELECT doc_id, md5(array_to_string(list_sort({terms('text')}), ' ')) AS terms_md5 FROM documents",
    "sentence_counts": f"SELECT doc_id, len({sentences('text')}) AS n_sentences, len({cut('text')}) AS n_cut, greatest(1, length(text) // 4) AS token_estimate FROM documents",
    "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_tokens, round(avg(len(w)), 6) AS avg_tokens FROM (SELECT {tokens('text')} AS w FROM documents)",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM documents) GROUP BY term",
    "postings": f"SELECT doc_id, count(*) AS n_terms, md5(string_agg(term || ':' || tf, ' ' ORDER BY term || ':' || tf)) AS postings_md5 FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY doc_id",
    "incremental_frequencies": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM documents WHERE doc_id % 6 <> 0) GROUP BY term",
    "bm25_search": f"WITH {TK} {_ROUNDED} ({bm25(QUESTION, 10)})",
    "bm25_filtered": f"WITH {TK} {_ROUNDED} ({bm25(QUESTION, 10, 'lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'de' + chr(39) + ')')})",
    "bm25_repeated_term": f"WITH {TK} {_ROUNDED} ({bm25('thtion thtion ertion', 20)})",
    "hash_embedding_buckets": r"""WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
 h AS (SELECT doc_id, n, sha256(word) AS h FROM w),
 b AS (SELECT doc_id, CAST(('0x' || h[1:8])::BIGINT % 384 AS BIGINT) AS bucket, sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN n ELSE -n END) AS w FROM h GROUP BY ALL HAVING sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN n ELSE -n END) <> 0)
 SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    "dense_topk": f"{_ROUNDED} ({dense(10)})",
    "dense_topk_filtered": f"{_ROUNDED} ({dense(10, 'e.label IN (1, 2, 3)')})",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dim FROM embeddings",
    "cosine_to_query": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "rrf_fusion": f"WITH {TK}, {fused(40, 20)} {_ROUNDED} g",
    "retrieval_overlap": f"WITH {TK}, s AS ({bm25(QUESTION, 100)}), v AS ({dense(100, key='doc_id')}) SELECT (SELECT count(*) FROM s) AS n_sparse, (SELECT count(*) FROM v) AS n_dense, (SELECT count(*) FROM s JOIN v USING (doc_id)) AS n_both",
    "lexical_rerank": f"WITH {TK}, s AS ({bm25(QUESTION, 40)}), {reranked('s')} SELECT doc_id, rank, round(rerank_score, 6) AS rerank_score, new_rank FROM n",
    "hybrid_search": f"WITH {TK}, {fused(40, 40)}, {reranked('g')} SELECT doc_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, new_rank, len({supporting('text')}) AS n_supporting FROM n WHERE new_rank <= 10",
    "supporting_sentences": f"SELECT doc_id, unnest(range(len(s))) AS n, md5(unnest(s).sentence) AS sentence_md5 FROM (SELECT doc_id, {supporting('text')} AS s FROM documents)",
    "comparison_table": comparison("", 1),
    "comparison_filtered": comparison(" AND metric_key = 'perplexity' AND dataset_key IN ('brand#11', 'brand#22')", 2),
    "comparison_spread": comparison_rows(2, "dataset_key, metric_key, n_cells, n_papers, spread, best_model, best_value"),
    "comparison_markdown": comparison_rows(1, r"dataset_key, metric_key, best_value, '| ' || dataset_key || ' | ' || metric_key || ' | ' || regexp_replace(printf('%.6f', best_value), '\.?0+$', '') || ' |' AS line"),
    "ungrouped_results": sql("SELECT count(*) FILTER (WHERE dataset_key IS NULL) AS ungrouped, count(*) AS total FROM results", "results"),
    "paper_matrix": sql(
        """SELECT paper_id, coalesce(published_year, 0) AS year, coalesce(datasets, '') AS datasets, coalesce(models, '') AS models, coalesce(metrics, '') AS metrics FROM papers LEFT JOIN (
        SELECT paper_id, string_agg(DISTINCT dataset_key, ',' ORDER BY dataset_key) AS datasets, string_agg(DISTINCT model_key, ',' ORDER BY model_key) AS models, string_agg(DISTINCT metric_key, ',' ORDER BY metric_key) AS metrics FROM results GROUP BY paper_id) USING (paper_id)""",
        "papers", "results"),
    "timeline": sql("SELECT published_year, count(*) AS n_papers, array_to_string(list_sort(list(title))[1:20], '|') AS titles FROM papers GROUP BY published_year", "papers"),
    "entity_trends": sql(TREND_OUT.format(n=15), "papers", "entities", extra="dated AS (SELECT label, name, paper_id, published_year FROM entities JOIN papers USING (paper_id) WHERE published_year IS NOT NULL), " + TREND),
    "trend_direction_venues": "WITH m AS (SELECT user_id AS paper_id, 'Type' AS label, event_type AS name, CAST(day(ts) AS INTEGER) AS published_year FROM events), dated AS (SELECT label, name, paper_id, published_year FROM (SELECT DISTINCT label, name, paper_id FROM m) JOIN (SELECT DISTINCT paper_id, published_year FROM m) USING (paper_id)), " + TREND + TREND_OUT.format(n=10),
    "entity_adoption": sql(
        "SELECT name, published_year, n FROM y WHERE name IN (SELECT name FROM y GROUP BY name ORDER BY sum(n) DESC, name LIMIT 8)", "papers", "entities",
        extra="y AS (SELECT name, published_year, count(*) AS n FROM entities JOIN papers USING (paper_id) WHERE label = 'Dataset' AND published_year IS NOT NULL GROUP BY ALL)"),
    "metric_progressions": sql(
        "SELECT p.*, points, improvement FROM p JOIN (SELECT dataset_key, metric_key, count(*) AS points, arg_max(value, published_year) - arg_min(value, published_year) AS improvement FROM p GROUP BY ALL HAVING count(*) >= 2 ORDER BY points DESC, dataset_key, metric_key LIMIT 6) USING (dataset_key, metric_key)",
        "papers", "results",
        extra="""p AS (SELECT dataset_key, metric_key, published_year, value, model_key FROM (SELECT *, row_number() OVER (PARTITION BY dataset_key, metric_key, published_year ORDER BY good DESC, k1, k2, k3, k4) AS n
          FROM results JOIN papers USING (paper_id) WHERE dataset_key IS NOT NULL AND published_year IS NOT NULL) WHERE n = 1)"""),
    "numeric_conflicts": sql("SELECT * FROM conflicts", "results", extra=CONFLICTS),
    "claim_extraction": sql("SELECT paper_id, claim_no, md5(claim) AS claim_md5 FROM cl", "chunks", extra=CLAIMS),
    "claim_candidate_pairs": sql(
        """SELECT l.paper_id AS left_paper, l.claim_no AS left_no, r.paper_id AS right_paper, r.claim_no AS right_no, round(len(list_intersect(l.w, r.w))::DOUBLE / len(list_distinct(list_concat(l.w, r.w))), 6) AS overlap
        FROM lw l JOIN lw r ON l.paper_id < r.paper_id WHERE len(list_intersect(l.w, r.w))::DOUBLE / len(list_distinct(list_concat(l.w, r.w))) >= 0.25 ORDER BY overlap DESC, left_paper, left_no, right_paper, right_no LIMIT 24""",
        "chunks", extra=CLAIMS + r", lw AS (SELECT paper_id, claim_no, list_distinct(list_filter(string_split_regex(lower(claim), '\s+'), lambda w: length(w) > 4)) AS w FROM cl)"),
    "coverage_gaps": sql("SELECT * FROM coverage", "papers", "entities", extra=COVERAGE),
    "evaluation_gaps": sql("SELECT * FROM evaluation", "results", extra=EVALUATION),
    "stated_gaps": sql(
        rf"""SELECT paper_id, chunk_index, gap_no, marker, md5(trim(regexp_replace(substring(content, greatest(1, pos - 80), pos + 320 - greatest(1, pos - 80)), '\s+', ' ', 'g'))) AS excerpt_md5 FROM (
        SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index DESC) AS gap_no FROM (
          SELECT *, coalesce({', '.join(f"CASE WHEN contains(lower(content), {quote(m)}) THEN {quote(m)} END" for m in MARKERS)}) AS marker,
            coalesce({', '.join(f"nullif(instr(lower(content), {quote(m)}), 0)" for m in MARKERS)}) AS pos,
            row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index DESC) AS back FROM chunks) WHERE back <= 12 AND marker IS NOT NULL) WHERE gap_no <= 2""", "chunks"),
    "structural_gaps": sql(
        """SELECT 'coverage' AS kind, label || ' / ' || name AS subject, ratio AS strength FROM coverage UNION ALL SELECT 'evaluation', model_key, strength FROM evaluation UNION ALL
        SELECT 'unresolved_conflict', model_key || ' / ' || dataset_key || ' / ' || metric_key || ' / ' || left_paper || ' / ' || right_paper, least(1.0, gap) FROM (SELECT * FROM conflicts ORDER BY gap DESC, model_key, dataset_key, metric_key, left_paper, right_paper LIMIT 5)""",
        "papers", "results", "entities", extra=", ".join((COVERAGE, EVALUATION, CONFLICTS))),
    "review_sources": sql("SELECT row_number() OVER (ORDER BY coalesce(published_year, 0) DESC, paper_id) AS source_index, paper_id, title FROM papers ORDER BY source_index LIMIT 40", "papers"),
    "coauthorship_nodes": sql("SELECT * FROM an", "authors", extra=AUTHORS),
    "coauthorship_edges": sql('SELECT l.author AS "left", r.author AS "right", count(*) AS weight FROM authors l JOIN authors r ON l.paper_id = r.paper_id AND l.author < r.author WHERE l.author IN (SELECT author FROM an) AND r.author IN (SELECT author FROM an) GROUP BY ALL', "authors", extra=AUTHORS),
    "citation_network_nodes": sql("SELECT p.paper_id, count(c.dst_paper) + 1 AS weight FROM papers p LEFT JOIN citations c ON c.dst_paper = p.paper_id GROUP BY p.paper_id ORDER BY weight DESC, p.paper_id LIMIT 80", "papers", "citations"),
    "citation_network_edges": sql("SELECT * FROM citations", "papers", "citations"),
    "entity_network_nodes": sql("SELECT * FROM en", "entities", extra=ENTITY_TOP),
    "entity_network_edges": sql("SELECT label, key, count(DISTINCT paper_id) AS n, min(paper_id) AS first_paper, max(paper_id) AS last_paper FROM entities WHERE (label, key) IN (SELECT (label, key) FROM en) GROUP BY label, key", "entities", extra=ENTITY_TOP),
    "entity_cooccurrence": sql("SELECT label, name, count(DISTINCT paper_id) AS n_papers FROM entities GROUP BY ALL ORDER BY n_papers DESC, label, name LIMIT 25", "entities"),
    "most_connected": sql("SELECT paper_id, title, n_keys FROM papers JOIN (SELECT paper_id, count(DISTINCT key) AS n_keys FROM entities GROUP BY paper_id ORDER BY n_keys DESC, paper_id LIMIT 10) USING (paper_id)", "papers", "entities"),
    "graph_counts": sql(counts("nodes", "edges"), "nodes"),
    "graph_neighbors_depth1": neighbors(1, ()),
    "graph_neighbors_depth2": neighbors(2, ("CITES", "AUTHORED_BY")),
    "graph_neighbors_depth3": neighbors(3, ("CITES",)),
    "graph_find_nodes": sql("SELECT uid, uid[9:] AS key FROM nodes WHERE label = 'Dataset' AND contains(uid[9:], '#2') ORDER BY key LIMIT 50", "nodes"),
    "graph_pattern": sql("SELECT src, dst FROM edges WHERE type = 'CITES' ORDER BY src, dst LIMIT 50", "edges"),
    "graph_seeds": sql("SELECT label, key, round(confidence, 6) AS confidence FROM sd", "entities", extra=SEEDS),
    "graph_expand": sql(
        "SELECT paper_id, count(*) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY label, key ORDER BY paper_id) AS n FROM (SELECT DISTINCT e.label, e.key, e.paper_id FROM entities e JOIN sd USING (label, key))) WHERE n <= 12 AND paper_id NOT IN (1, 2, 3) GROUP BY paper_id ORDER BY strength DESC, paper_id LIMIT 12",
        "entities", extra=SEEDS),
    "edge_legality": sql("SELECT type, count(*) AS n FROM edges GROUP BY type", "edges"),
    "graph_delete_paper": sql(counts("(SELECT * FROM nodes WHERE uid <> 'Paper:1')", "(SELECT * FROM edges WHERE src <> 'Paper:1' AND dst <> 'Paper:1')"), "nodes"),
    "graph_upsert": sql("SELECT type, count(*) AS n FROM (SELECT src, type, dst FROM edges UNION SELECT dst, type, src FROM edges WHERE type = 'CITES') GROUP BY type", "edges"),
    "graph_dangling": sql("SELECT type, count(*) AS n FROM edges WHERE split_part(dst, ':', 1) <> 'Venue' GROUP BY type", "edges"),
    "chunk_token_stats": sql("SELECT kind, count(*) AS n, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS tokens, max(length(content)) AS longest FROM chunks GROUP BY kind", "chunks"),
    "default_gazetteer_counts": _gaz(lx.ENTITY_TERMS, "SELECT label, name, count(*) AS n FROM h GROUP BY ALL"),
    "gazetteer_entities": _gaz(TERMS, "SELECT doc_id, label, name, md5(trim(replace(substring(t, greatest(1, pos - 60), 120), chr(10), ' '))) AS evidence_md5 FROM h"),
    "breadcrumbs": sql(
        """SELECT paper_id, chunk_index, level, concat_ws(' > ', CASE WHEN level >= 1 THEN t1 END, CASE WHEN level >= 2 AND (c2 IS NULL OR c2 < o2) THEN t2 END, CASE WHEN level >= 3 AND (c3 IS NULL OR c3 < o3) THEN t3 END) AS path FROM (
        SELECT *, last(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2, last(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER w AS t3,
          max(CASE WHEN level = 2 THEN chunk_index END) OVER w AS o2, max(CASE WHEN level = 3 THEN chunk_index END) OVER w AS o3, max(CASE WHEN level < 2 THEN chunk_index END) OVER w AS c2, max(CASE WHEN level < 3 THEN chunk_index END) OVER w AS c3
        FROM (SELECT *, CAST(1 + length(content) % 3 AS INTEGER) AS level, 'S' || chunk_index AS title FROM chunks) WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING))""", "chunks"),
    "nearest_caption": """WITH b AS (SELECT l_orderkey % 997 AS page, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, l_quantity * 20 AS top, l_quantity * 20 + 15 AS bottom FROM lineitem),
 c AS (SELECT p_partkey % 997 AS page, p_partkey AS cap_id, p_size * 20.0 + 3 AS ct, p_size * 20.0 + 10 AS cb FROM part)
 SELECT page, box_id, cap_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY distance, cap_id) AS n FROM (
   SELECT b.page, box_id, cap_id, least(abs(ct - bottom), abs(top - cb))::DOUBLE AS distance FROM b JOIN c USING (page)) WHERE distance <= 60) WHERE n = 1""",
    "split_author_strings": "SELECT c_custkey, c_name || '|A|'  || c_mktsegment || '|Wu Wei' AS authors FROM customer".replace("'|A|'  ||", "'|' ||"),
    "citation_markers": r"""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all('As [' || turn || '] and [2], [2], [77] say, [123].', '\[(\d{1,2})\]', 1), lambda x: CAST(x AS INTEGER)), lambda i: i BETWEEN 1 AND 5))), lambda x: CAST(x AS VARCHAR)), ',') AS cited FROM conversations""",
    "metric_keys": "SELECT p_partkey, (['f1', 'exact match', 'ndcg', 'ndcg@5', 'roc-auc', 'latency', 'bleu'])[p_partkey % 7 + 1] AS metric, p_partkey % 7 <> 5 AS higher FROM part",
    "title_from_html": r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '')) AS title FROM pages""",
    "sanitize_pages": f"SELECT page_id, md5({SNIPPET}) AS snippet_md5, length({SNIPPET}) AS n_chars FROM pages",
    "injection_flags": rf"SELECT page_id, coalesce({_first_match('s', (chr(92) + 'bthe' + chr(92) + 's+of' + chr(92) + 'b', '<' + chr(92) + 's*/?' + chr(92) + 's*(?:system|assistant)' + chr(92) + 's*>', 'ertion'))}, '') AS reason FROM (SELECT page_id, {SNIPPET} AS s FROM pages)",
    "checksums": "SELECT doc_id, sha256(text) AS checksum, 'papers/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) || '.' || lower(lang) AS storage_key FROM documents",
    "eval_scores": f"WITH {JUDGED} SELECT conv_id, turn, faithfulness, answer_relevancy, context_precision, context_recall, citation_validity, overall FROM sc",
    "eval_gate": f"WITH {JUDGED}, {GATED} SELECT conv_id, turn, failures = '' AS passed, failures FROM ga",
    "eval_report": f"""WITH {JUDGED}, {GATED}, gr AS (SELECT *, conv_id % 7 <> 0 AS graded FROM ga) SELECT count(*) FILTER (WHERE graded) AS graded, count(*) FILTER (WHERE graded AND failures = '') AS n_passed, count(*) FILTER (WHERE NOT graded) AS n_skipped,
 count(*) FILTER (WHERE graded) > 0 AND count(*) FILTER (WHERE graded AND failures <> '') = 0 AS all_passed, {', '.join(f"round(coalesce(avg({m}) FILTER (WHERE graded), 0.0), 4) AS {m}" for m in ('faithfulness', 'answer_relevancy', 'context_precision', 'context_recall', 'citation_validity', 'overall'))} FROM gr""",
    "eval_case_hits": "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "paper_status_counts": sql("SELECT status, count(*) AS n FROM papers GROUP BY status", "papers"),
    "corpus_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "embeddings", "conversations", "benchmark", "labels")),
    "papers_page": sql("SELECT *, (SELECT count(*) FROM papers) AS total FROM papers ORDER BY coalesce(published_year, 0) DESC, paper_id DESC LIMIT 25 OFFSET 20", "papers"),
    "authorized_papers": sql("SELECT workspace_id, status, count(*) AS n FROM papers WHERE workspace_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY ALL", "papers"),
    "replace_paper_chunks": sql("SELECT paper_id, count(*) AS n, md5(string_agg(CASE WHEN paper_id % 10 = 0 THEN 'new: ' || content ELSE content END, '|' ORDER BY chunk_index)) AS content_md5 FROM chunks GROUP BY paper_id", "chunks"),
    "upload_intake": """WITH u AS (SELECT doc_id % 5 AS workspace_id, md5(text) AS checksum, 'a/b/Report ' || doc_id || '..PDF' AS filename, length(text) AS size_bytes, doc_id % 11 <> 0 AS is_pdf, doc_id FROM documents),
 j AS (SELECT *, CASE WHEN size_bytes <= 0 THEN 'empty' WHEN size_bytes > 104857600 THEN 'too large' WHEN NOT is_pdf THEN 'not a PDF' END AS reason FROM u),
 n AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, checksum ORDER BY filename) AS n FROM j WHERE reason IS NULL)
 SELECT workspace_id, checksum, filename, reason FROM j WHERE reason IS NOT NULL UNION ALL
 SELECT workspace_id, checksum, CASE WHEN n = 1 AND workspace_id <> 1 THEN 'Report ' || doc_id || '.PDF' ELSE filename END, CASE WHEN n = 1 AND workspace_id <> 1 THEN '' ELSE 'already there' END FROM n""",
    "http_rate_5m": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type AS route, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM events GROUP BY ALL",
    "error_ratio": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio FROM events GROUP BY ALL",
    "latency_quantiles": f"SELECT event_type AS route, {_QUANT} FROM events GROUP BY event_type",
    "bucket_histogram": "SELECT event_type AS route, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0])::DOUBLE AS le) GROUP BY ALL",
    "counter_vs_baseline": "SELECT window_start, round(total, 4) AS total, round(baseline, 4) AS baseline FROM (SELECT *, avg(total) OVER (ORDER BY window_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS baseline FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, sum(value) AS total FROM events GROUP BY 1)) WHERE total > baseline",
    "user_sessions": """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
   SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s""",
    "refusal_flags": f"SELECT conv_id, turn, {' OR '.join(f'contains(lower(text), {quote(m)})' for m in (*lx.REFUSAL_MARKERS, *MARKERS))} AS refuses FROM conversations",
}

assert math.isclose(lx.BM25_K1 + 1, 2.5)

ORACLES["bm25_from_index"] = ORACLES["bm25_search"]
ORACLES["paper_graph"] = sql(
    """SELECT label AS kind, count(*) AS n FROM (SELECT uid, label FROM nodes UNION SELECT 'Paper:' || paper_id, 'Paper' FROM papers) GROUP BY label
    UNION ALL SELECT type, count(*) FROM (SELECT DISTINCT * FROM edges) GROUP BY type""",
    "nodes",
)
ORACLES["reported_results"] = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS doc_id,
    CASE any_value(l_returnflag) WHEN 'A' THEN 'accuracy' WHEN 'N' THEN 'f1' ELSE 'perplexity' END AS metric, any_value(CAST(CAST(l_quantity AS INTEGER) AS DOUBLE)) AS value,
    any_value(CASE WHEN l_linestatus = 'O' THEN '%' ELSE '' END) AS unit, CASE WHEN l_linenumber % 2 = 0 THEN 'squad' ELSE 'coco' END AS dataset, 0.5::DOUBLE AS confidence
    FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey"""
ORACLES["parsed_references"] = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS "order", '10.5555/ord' || o_orderkey AS doi,
    CAST(year(o_orderdate) AS INTEGER) AS year, 'Study of item p' || o_orderkey || ' in depth' AS title FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 2)"""
ORACLES["figure_blocks"] = f"SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity * 4 * (l_discount * 1000) >= {lx.MIN_FIGURE_AREA} GROUP BY l_linenumber"
ORACLES["first_extractions"] = """SELECT l_orderkey AS paper_id, lower(p_brand) AS key, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(p_brand) ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""
ORACLES["latency_bucket_quantiles"] = f"""WITH t AS (SELECT event_type AS route, count(value) AS n FROM events GROUP BY event_type),
    c AS (SELECT event_type AS route, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest({list(BOUNDS)}::DOUBLE[]) AS le) GROUP BY event_type, le)
    SELECT route, {", ".join(map(_bucket_quantile, (0.5, 0.95, 0.99)))} FROM t"""
ORACLES["usage_totals"] = """SELECT model, count(*) AS calls, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE k END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN k ELSE 0 END) AS BIGINT) AS completion_tokens,
    CAST(sum(k) AS BIGINT) AS total_tokens FROM (SELECT 'm' || (conv_id % 3) AS model, role, greatest(1, length(text) // 4) AS k FROM conversations) GROUP BY model"""
ORACLES["external_blocks"] = f"""WITH titles AS ({ORACLES["title_from_html"]}),
    p AS (SELECT page_id % 20 AS batch, page_id, coalesce(title, '') AS title, url, substring(html, 1, 40) AS snippet, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS n FROM pages JOIN titles USING (page_id))
    SELECT batch, md5(string_agg('<<<EXTERNAL_RESULT ' || n || '>>>' || chr(10) || 'title: ' || title || chr(10) || 'url: ' || url || chr(10) || 'content: ' || snippet || chr(10) || '<<<END_EXTERNAL_RESULT ' || n || '>>>',
      chr(10) || chr(10) ORDER BY n)) AS block_md5 FROM p GROUP BY batch"""

#: A fold over the lines of each document: a line that does not fit opens the next group.
PACKED = r"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, line, CAST(length(line) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
   FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE line <> ''),
 f(doc_id, i, grp, used) AS (SELECT doc_id, i, CAST(0 AS BIGINT), n FROM l WHERE i = 1
   UNION ALL SELECT l.doc_id, l.i, CASE WHEN used + 1 + n > 600 THEN grp + 1 ELSE grp END, CASE WHEN used + 1 + n > 600 THEN n ELSE used + 1 + n END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
 SELECT doc_id, CAST(grp AS INTEGER) AS chunk_index, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS content_md5 FROM (SELECT f.doc_id, grp, string_agg(line, chr(10) ORDER BY f.i) AS c FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY f.doc_id, grp)"""

_KNOWN = "^[ \\t]*(" + "|".join(lx.HEADING_WORDS) + ")[ \\t]*$"
#: Lines with their headings, headings numbered, bodies put together, and the titles of the open levels.
SECTIONS = rf"""m AS (SELECT doc_id, pos, line, regexp_extract(line, '{lx.NUMBERED_HEADING}', 1) AS num, regexp_matches(line, '{lx.ROMAN_HEADING}') AS roman, regexp_matches(line, '{_KNOWN}') AS known
   FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
 h AS (SELECT doc_id, pos, line, CASE WHEN num <> '' THEN len(string_split(num, '.')) WHEN roman OR known THEN 1 END AS level,
   CASE WHEN num <> '' THEN trim(regexp_extract(line, '{lx.NUMBERED_HEADING}', 2)) WHEN roman THEN trim(regexp_extract(line, '{lx.ROMAN_HEADING}', 1))
     WHEN known THEN array_to_string(list_transform(string_split(lower(trim(line, ' ' || chr(9))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS title FROM m),
 n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM h),
 g AS (SELECT doc_id, no, max(level) AS level, max(title) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level IS NULL), ''), ' ' || chr(10) || chr(9)) AS body FROM n GROUP BY doc_id, no),
 b AS (SELECT doc_id, no, body, coalesce(level, 1) AS level, CASE WHEN no > 0 THEN title WHEN last_no > 0 THEN 'Front Matter' ELSE 'Document' END AS title
   FROM (SELECT *, max(no) OVER (PARTITION BY doc_id) AS last_no FROM g) WHERE body <> ''),
 o AS (SELECT *, max(CASE WHEN level = 1 THEN no END) OVER w AS o1, max(CASE WHEN level = 2 THEN no END) OVER w AS o2, max(CASE WHEN level = 3 THEN no END) OVER w AS o3 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
 sections AS (SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.no) - 1 AS section_no, o.title, o.level, o.body,
   concat_ws(' > ', t1.title, CASE WHEN o.level >= 2 AND (o1 IS NULL OR o1 < o2) THEN t2.title END, CASE WHEN o.level >= 3 AND coalesce(greatest(o1, o2), -1) < o3 THEN t3.title END) AS path
   FROM o LEFT JOIN b t1 ON t1.doc_id = o.doc_id AND t1.no = o1 LEFT JOIN b t2 ON t2.doc_id = o.doc_id AND t2.no = o2 LEFT JOIN b t3 ON t3.doc_id = o.doc_id AND t3.no = o3)"""

SPLIT = f"WITH {SECTIONS} SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, title, CAST(level AS INTEGER) AS level, path, CAST(length(body) AS INTEGER) AS n_chars FROM sections"

#: Steps: P a paragraph that fits, S a sentence of one that does not, C a cut of a sentence over the budget, E an end of what is held.
CHUNKED = rf"""WITH RECURSIVE {SECTIONS},
 p AS (SELECT doc_id, section_no, k, trim(q, ' ' || chr(10) || chr(9) || chr(13)) AS q FROM (SELECT doc_id, section_no, unnest(range(len(ps))) AS k, unnest(ps) AS q FROM (SELECT doc_id, section_no, string_split_regex(body, '\n[ \t]*\n') AS ps FROM sections))),
 s AS (SELECT doc_id, section_no, k, unnest(range(len(ss))) AS j, unnest(ss) AS t FROM (
   SELECT *, string_split(regexp_replace(q, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM p WHERE length(q) > 2048)),
 cut AS (SELECT doc_id, section_no, k, j, t, unnest(range(CAST(1 + greatest(0, ceil((length(t) - 2048) / 1792.0)) AS BIGINT))) AS c FROM s),
 steps AS (SELECT doc_id, section_no, k, -1 AS j, 0 AS c, 'P' AS op, q AS t FROM p WHERE length(q) BETWEEN 1 AND 2048
   UNION ALL SELECT doc_id, section_no, k, -1, 0, 'E', '' FROM p WHERE length(q) > 2048
   UNION ALL SELECT doc_id, section_no, k, j, c, CASE WHEN length(t) - c * 1792 > 2048 THEN 'C' ELSE 'S' END, CASE WHEN length(t) - c * 1792 > 2048 THEN substring(t, c * 1792 + 1, 2048) ELSE substring(t, c * 1792 + 1) END FROM cut
   UNION ALL SELECT doc_id, section_no, k, 1000000000, 0, 'E', '' FROM p WHERE length(q) > 2048
   UNION ALL SELECT doc_id, section_no, 1000000000, 0, 0, 'E', '' FROM sections),
 step AS MATERIALIZED (SELECT doc_id, section_no, op, t, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY k, j, c) AS i FROM steps),
 f(doc_id, section_no, i, held, o1, o2) AS (SELECT doc_id, section_no, CAST(0 AS BIGINT), '', '', '' FROM sections
   UNION ALL SELECT doc_id, section_no, i,
     CASE op WHEN 'P' THEN CASE WHEN held = '' OR full_p THEN t ELSE held || chr(10) || chr(10) || t END WHEN 'S' THEN trim(CASE WHEN full_s THEN right(held, 256) ELSE held END || ' ' || t) ELSE '' END,
     CASE WHEN op IN ('E', 'C') OR op = 'P' AND full_p OR op = 'S' AND full_s THEN held ELSE '' END, CASE WHEN op = 'C' THEN t ELSE '' END
   FROM (SELECT f.doc_id, f.section_no, step.i, op, t, held, held <> '' AND length(held) + 2 + length(t) > 2048 AS full_p, held <> '' AND length(held) + 1 + length(t) > 2048 AS full_s
     FROM f JOIN step ON step.doc_id = f.doc_id AND step.section_no = f.section_no AND step.i = f.i + 1)),
 made AS (SELECT doc_id, section_no, i, 1 AS half, trim(o1, ' ' || chr(10) || chr(9) || chr(13)) AS content FROM f UNION ALL SELECT doc_id, section_no, i, 2, trim(o2, ' ' || chr(10) || chr(9) || chr(13)) FROM f),
 kept AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section_no) AS n_pieces FROM made WHERE content <> '')
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, i, half) - 1 AS INTEGER) AS chunk_index, path AS section_path, md5(content) AS content_md5, CAST(greatest(1, length(content) // 4) AS INTEGER) AS token_estimate
 FROM kept JOIN sections USING (doc_id, section_no) WHERE n_pieces = 1 OR length(content) >= 80"""

#: Each query's hits are folded in order; a chunk that does not fit is cut to the first supporting sentences that do.
CONTEXT = f"""WITH RECURSIVE {TK}, hits AS ({bm25(QUESTION, 200)}),
 r AS MATERIALIZED (SELECT lang AS query_id, rank AS pos, text, greatest(1, length(text) // 4) AS need, {supporting('text', 6)} AS short, row_number() OVER (PARTITION BY lang ORDER BY rank) AS i FROM hits JOIN documents USING (doc_id)),
 sums AS MATERIALIZED (SELECT query_id, i, n, sum(k) OVER (PARTITION BY query_id, i ORDER BY n) AS upto FROM (SELECT query_id, i, unnest(range(1, len(short) + 1)) AS n, greatest(1, length(unnest(short).sentence) // 4) AS k FROM r)),
 f(query_id, i, remaining, action, tokens, n) AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(4800 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM r
   UNION ALL SELECT query_id, i, remaining - CASE WHEN need <= remaining THEN need WHEN remaining >= 40 THEN coalesce(fits, 0) ELSE 0 END, CASE WHEN need <= remaining THEN 'kept' WHEN remaining >= 40 AND fits > 0 THEN 'compressed' ELSE 'dropped' END,
     CASE WHEN need <= remaining THEN need WHEN remaining >= 40 THEN coalesce(fits, 0) ELSE 0 END, coalesce(n_fit, 0)
   FROM (SELECT f.query_id, r.i, need, remaining, max(upto) FILTER (WHERE upto <= remaining) AS fits, max(sums.n) FILTER (WHERE upto <= remaining) AS n_fit
     FROM f JOIN r ON r.query_id = f.query_id AND r.i = f.i + 1 LEFT JOIN sums ON sums.query_id = r.query_id AND sums.i = r.i GROUP BY f.query_id, r.i, need, remaining))
 SELECT query_id, CAST(pos AS INTEGER) AS "at", action, CAST(tokens AS INTEGER) AS tokens, md5(CASE action WHEN 'kept' THEN text WHEN 'compressed' THEN array_to_string(list_transform(short[1:n], lambda x: x.sentence), ' ') ELSE '' END) AS content_md5
 FROM f JOIN r USING (query_id, i)"""

ORACLES |= {"pack_paragraphs": PACKED, "split_sections": SPLIT, "chunk_documents": CHUNKED, "context_packing": CONTEXT}

ORACLES["comparison_lines"] = sql(
    """SELECT dataset_key, metric_key, rank, '| ' || concat_ws(' | ', dataset_key, metric_key, model_key, CASE WHEN rank = 1 THEN '**' || shown || '**' ELSE shown END, title) || ' |' AS line
    FROM (SELECT *, printf('%g', value::DOUBLE) || CASE WHEN metric_key = 'accuracy' THEN '%' ELSE '' END AS shown FROM c) JOIN papers USING (paper_id)""",
    "papers", "results", extra=f"c AS ({CELLS.format(more='')})")
ORACLES["all_gaps"] = f"""SELECT kind, subject, strength::DOUBLE AS strength FROM ({ORACLES["structural_gaps"]})
    UNION ALL SELECT 'stated', concat_ws(' / ', paper_id, chunk_index, excerpt_md5), NULL FROM ({ORACLES["stated_gaps"]})"""
ORACLES["review_markdown"] = r"""WITH s AS (SELECT conv_id, turn, text || ' [1] [3] [9] [' || turn || ']' AS t, '## ' || role || ' ' || turn AS h, [1, turn, 9] AS available FROM conversations),
    u AS (SELECT DISTINCT conv_id, CAST(unnest(regexp_extract_all(t, '\[(\d{1,2})\]', 1)) AS BIGINT) AS i, available FROM s),
    cited AS (SELECT DISTINCT conv_id, i FROM u WHERE i BETWEEN 1 AND 4 AND list_contains(available, i)),
    l AS (SELECT conv_id, count(*) AS n_cited, string_agg(i || '. Paper ' || i, chr(10) ORDER BY i) AS listed FROM cited GROUP BY conv_id),
    b AS (SELECT conv_id, string_agg(h || chr(10) || chr(10) || trim(t, ' ' || chr(10) || chr(9)), chr(10) || chr(10) ORDER BY turn) AS texts, sum(len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))) AS n_words FROM s GROUP BY conv_id)
    SELECT conv_id AS review_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_cited AS INTEGER) AS n_cited, md5(texts || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || listed) AS markdown_md5 FROM b JOIN l USING (conv_id)"""

ORACLES["index_frequencies"] = ORACLES["incremental_frequencies"]
ORACLES["vector_index_search"] = ORACLES["dense_topk"]
ORACLES["vector_index_filtered"] = ORACLES["dense_topk_filtered"]
ORACLES["vector_index_many"] = """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""
ORACLES["vector_index_updates"] = """SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT e.vec_id, round(CASE WHEN e.vec_id % 3 < 2 THEN -1 ELSE 1 END * list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 7 <> 0) ORDER BY score DESC, vec_id LIMIT 100"""
_LANGS = "lang IN ('en', 'de')"
ORACLES["hybrid_scan"] = ORACLES["hybrid_filtered"] = f"""WITH {TK}, {fused(40, 40, _LANGS, f"e.vec_id IN (SELECT doc_id FROM documents WHERE {_LANGS})")}, {reranked('g')}
    SELECT doc_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, new_rank FROM n WHERE new_rank <= 10"""

#: Every item against every document: keyword scores of the words both have.
_ITEM_SCORES = f"""{TK},
 bq AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
 dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM tk) GROUP BY ALL), dl AS (SELECT doc_id, len(tok) AS dl FROM tk),
 dq AS (SELECT term, count(*) AS df FROM dt GROUP BY term), st AS (SELECT count(*) AS n, avg(len(tok)) AS avg FROM tk),
 sp AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))), 12) AS score FROM bq JOIN dt USING (term) JOIN dq USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
 sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sp)"""
ORACLES["benchmark_keyword_hits"] = f"WITH {_ITEM_SCORES} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 10"
ORACLES["benchmark_retrieval"] = rf"""WITH {_ITEM_SCORES},
 w AS (SELECT src, id, word, count(*) AS n FROM (SELECT 0 AS src, doc_id AS id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents UNION ALL SELECT 1, item_id, unnest(string_split_regex(lower(text), '\s+')) FROM benchmark) WHERE word <> '' GROUP BY ALL),
 h AS (SELECT word, sha256(word) AS h FROM (SELECT DISTINCT word FROM w)),
 p AS (SELECT src, id, ('0x' || h[1:8])::BIGINT % 384 AS bucket, CAST(sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS x FROM w JOIN h USING (word) GROUP BY ALL),
 u AS (SELECT src, id, bucket, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY src, id)), 0) AS x FROM p),
 ds AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.x * d.x), 9) AS score FROM u q JOIN u d USING (bucket) WHERE q.src = 1 AND d.src = 0 GROUP BY ALL),
 dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds),
 f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
   FROM (SELECT * FROM dr WHERE rank <= 40) a FULL JOIN (SELECT * FROM sr WHERE rank <= 40) b ON a.item_id = b.item_id AND a.doc_id = b.doc_id)
 SELECT item_id, doc_id, dense_rank, sparse_rank, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 1 ELSE 0 END DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
_APART = "abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9) >= 0.05"
ORACLES["conflict_ranges"] = sql(
    f"""SELECT l.model_key, l.dataset_key, l.metric_key, l.paper_id, l.value, count(*) FILTER (WHERE r.value < l.value AND {_APART}) AS n_below, max(r.value) FILTER (WHERE r.value < l.value AND {_APART}) AS highest_below,
    count(*) FILTER (WHERE r.value > l.value AND {_APART}) AS n_above, min(r.value) FILTER (WHERE r.value > l.value AND {_APART}) AS lowest_above
    FROM last l JOIN last r USING (model_key, dataset_key, metric_key) GROUP BY ALL""", "results", extra=CONFLICTS)  # fmt: skip

ORACLES["stored_paper_chunks"] = sql(
    """SELECT paper_id, count(*) AS n, md5(string_agg(CASE WHEN paper_id % 10 = 0 THEN 'new: ' ELSE '' END || content, '|' ORDER BY chunk_index)) AS content_md5 FROM chunks WHERE paper_id % 10 <> 3 GROUP BY paper_id""", "chunks")  # fmt: skip
ORACLES["stored_blobs"] = """SELECT 'docs/' || doc_id AS key, sha256(t) AS checksum, CAST(octet_length(encode(t)) AS BIGINT) AS size_bytes
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v2 ' ELSE '' END || coalesce(text, '') AS t FROM documents WHERE doc_id % 7 <> 0)"""
ORACLES["graph_stored"] = sql("SELECT type, count(*) AS n FROM (SELECT DISTINCT * FROM edges) GROUP BY type", "edges")
ORACLES["graph_neighbors_many"] = sql(
    """SELECT start, uid, min(distance)::INTEGER AS distance, max(direction) FILTER (WHERE distance = least) AS direction FROM (SELECT *, min(distance) OVER (PARTITION BY start, uid) AS least FROM (
    SELECT start, uid, 1 AS distance, direction FROM one UNION ALL SELECT one.start, step.uid, 2, step.direction FROM one JOIN step ON step.node = one.uid)) WHERE uid <> start GROUP BY start, uid""", "edges",
    extra="""step AS (SELECT src AS node, dst AS uid, 'out' AS direction FROM edges WHERE type = 'CITES' UNION ALL SELECT dst, src, 'in' FROM edges WHERE type = 'CITES'),
    seeds AS (SELECT DISTINCT 'Paper:' || paper_id AS start FROM papers WHERE paper_id % 20 = 0), one AS (SELECT DISTINCT start, uid, direction FROM seeds JOIN step ON node = start)""")  # fmt: skip
_DICT = r"""SELECT DISTINCT label, name, '(^|[^A-Za-z0-9_])(' || name || ')([^A-Za-z0-9_]|$)' AS pattern FROM (SELECT 'word' AS label, unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS name FROM benchmark
    UNION ALL SELECT 'pair', regexp_extract(lower(text), '^([a-z]+ [a-z]+)', 1) FROM benchmark) WHERE name <> ''"""
ORACLES["dictionary_hits"] = f"""WITH g AS ({_DICT}), h AS (SELECT doc_id, label, name, text AS t, length(regexp_extract(lower(text), '(?s)^(.*?)' || pattern, 1)) + length(regexp_extract(lower(text), pattern, 1)) + 1 AS pos
    FROM documents, g WHERE contains(lower(text), name) AND regexp_matches(lower(text), pattern))
    SELECT doc_id, label, name, md5(trim(replace(substring(t, greatest(1, pos - 60), 120), chr(10), ' '))) AS evidence_md5 FROM h"""

_JUDGED_PAIRS = f"""j AS (SELECT *, CASE WHEN overlap >= 0.5 THEN 'agreement' WHEN (left_paper + right_paper) % 2 = 1 THEN 'contradiction' ELSE 'unrelated' END AS relation FROM ({ORACLES["claim_candidate_pairs"]}))"""
_CLAIM_ROWS = sql("SELECT * FROM cl", "chunks", extra=CLAIMS)
ORACLES["judged_claims"] = f"""WITH {_JUDGED_PAIRS}, c AS ({_CLAIM_ROWS}) SELECT left_paper, left_no, right_paper, right_no, relation, round(overlap, 6) AS confidence, md5(l.claim || '|' || r.claim || '|by rule') AS told_md5
    FROM j JOIN c l ON l.paper_id = left_paper AND l.claim_no = left_no JOIN c r ON r.paper_id = right_paper AND r.claim_no = right_no"""
ORACLES["consistency_report"] = f"""WITH {_JUDGED_PAIRS}, n AS (SELECT count(*) AS numeric_conflicts FROM ({ORACLES["numeric_conflicts"]})),
    c AS (SELECT count(*) FILTER (WHERE relation = 'contradiction') AS contradictions, count(*) FILTER (WHERE relation = 'agreement') AS agreements FROM j),
    p AS (SELECT count(DISTINCT o_orderkey) AS papers_examined FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT papers_examined, numeric_conflicts, contradictions, agreements, 0 AS unjudged, numeric_conflicts = 0 AND contradictions = 0 AS is_consistent,
    CASE WHEN papers_examined < 2 THEN 'At least two papers are needed to compare claims.' WHEN numeric_conflicts = 0 AND contradictions = 0 THEN 'No conflicts found across ' || papers_examined || ' papers.'
      ELSE numeric_conflicts || ' numeric conflict(s) and ' || contradictions || ' contradicting claim(s) across ' || papers_examined || ' papers.' END AS summary FROM n, c, p"""


def _increase(rows: str, keys: str) -> str:
    """Growth since the sample before of each series; a smaller total than before is growth from nothing."""
    return f"SELECT *, CASE WHEN b IS NULL THEN 0 WHEN total < b THEN total ELSE total - b END AS increase FROM (SELECT *, lag(total) OVER (PARTITION BY {keys} ORDER BY ts, total) AS b FROM ({rows}))"


def _counter(measure: str) -> str:
    return f"SELECT event_type AS series, ts, sum({measure}) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events"


ORACLES["counter_rates"] = f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, series, CAST(sum(increase) AS DOUBLE) AS increase, round(sum(increase) / 3600.0::DOUBLE, 6) AS per_second FROM ({_increase(_counter("1"), "series")}) GROUP BY ALL"""
ORACLES["counter_quantiles"] = f"""WITH e AS (SELECT *, unnest([{", ".join(f"{b}::DOUBLE" for b in BOUNDS)}, 'inf'::DOUBLE]) AS le FROM events),
    s AS (SELECT event_type AS stage, le, ts, count(*) FILTER (WHERE value <= le) OVER (PARTITION BY event_type, le, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
    w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, stage, le, CAST(sum(increase) AS DOUBLE) AS n FROM ({_increase("SELECT * FROM s", "stage, le")}) GROUP BY ALL),
    g AS (SELECT window_start, stage, list({{'le': le, 'n': n}} ORDER BY le) AS l, max(n) AS total FROM w GROUP BY ALL HAVING max(n) > 0),
    h AS (SELECT *, list_filter(l, lambda x: x.le < 'inf'::DOUBLE AND x.n >= 0.95::DOUBLE * total)[1] AS hit, list_filter(l, lambda x: x.le < 'inf'::DOUBLE AND x.n < 0.95::DOUBLE * total)[-1] AS low FROM g)
    SELECT window_start, stage, round(CASE WHEN hit IS NULL THEN {float(BOUNDS[-1])}::DOUBLE ELSE coalesce(low.le, 0) + (hit.le - coalesce(low.le, 0)) * (0.95::DOUBLE * total - coalesce(low.n, 0)) / (hit.n - coalesce(low.n, 0)) END, 6) AS quantile FROM h"""
ORACLES["spend_spikes"] = f"""WITH s AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS n, CAST(sum(increase) AS DOUBLE) AS grown FROM ({_increase(_counter("ceil(value)"), "series")}) GROUP BY 1),
    r AS (SELECT n, grown / 900 AS recent, coalesce(sum(grown) OVER (ORDER BY n RANGE BETWEEN 27 PRECEDING AND 4 PRECEDING), 0) / 21600 AS baseline FROM s)
    SELECT CAST(to_timestamp(n * 900) AS TIMESTAMP) AS window_start, round(recent, 6) AS recent, round(baseline, 6) AS baseline FROM r WHERE recent > 1.5 * baseline"""

ORACLES["timeline_span"] = sql("SELECT min(published_year) AS first_year, max(published_year) AS last_year, count(*) AS total_papers, count(*) FILTER (WHERE published_year IS NULL) AS undated_papers FROM papers", "papers")

_HASHED_WORDS = r"""CAST(('0x' || sha256(word)[1:8])::BIGINT % 384 AS BIGINT) AS bucket, CAST(sum(CASE WHEN ('0x' || sha256(word)[9:10])::BIGINT % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS x"""
#: A section only sees the documents of its review; keyword statistics are those of all documents.
ORACLES["review_passages"] = rf"""WITH {TK},
 src AS (SELECT source AS review_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY 2000 + doc_id % 25 DESC, doc_id) AS source_index FROM documents QUALIFY source_index <= 40),
 aims(section_no, aim) AS (VALUES (0, 'Overview. thtion attion'), (1, 'Methods. ertion thanea')),
 q AS (SELECT DISTINCT review_id, section_no, trim(text || '. ' || aim) AS query FROM src JOIN benchmark ON item_id = CAST(substring(review_id, 4) AS BIGINT), aims),
 qt AS (SELECT review_id, section_no, term, count(*) AS times FROM (SELECT review_id, section_no, unnest({tokens('query')}) AS term FROM q) GROUP BY ALL),
 dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM tk) GROUP BY ALL), dl AS (SELECT doc_id, len(tok) AS dl FROM tk),
 dq AS (SELECT term, count(*) AS df FROM dt GROUP BY term), st AS (SELECT count(*) AS n, avg(len(tok)) AS avg FROM tk),
 sp AS (SELECT review_id, section_no, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))), 12) AS score FROM qt JOIN src USING (review_id) JOIN dt USING (doc_id, term) JOIN dq USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
 a AS (SELECT *, row_number() OVER (PARTITION BY review_id, section_no ORDER BY score DESC, doc_id) AS r FROM sp QUALIFY r <= 24),
 w AS (SELECT 'd' || doc_id AS id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL
   UNION ALL SELECT review_id || '/' || section_no, word, count(*) FROM (SELECT review_id, section_no, unnest(string_split_regex(lower(query), '\s+')) AS word FROM q) WHERE word <> '' GROUP BY ALL),
 p AS (SELECT id, {_HASHED_WORDS} FROM w GROUP BY id, bucket), u AS (SELECT id, bucket, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x FROM p),
 ds AS (SELECT review_id, section_no, doc_id, round(coalesce(sum(uq.x * ud.x), 0), 9) AS score FROM q JOIN src USING (review_id) LEFT JOIN u uq ON uq.id = review_id || '/' || section_no LEFT JOIN u ud ON ud.id = 'd' || doc_id AND ud.bucket = uq.bucket GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY review_id, section_no ORDER BY score DESC, doc_id) AS r FROM ds QUALIFY r <= 24),
 f AS (SELECT review_id, section_no, doc_id, a.r AS sr, b.r AS dr, coalesce(1.0::DOUBLE / (60 + b.r), 0) + coalesce(1.0::DOUBLE / (60 + a.r), 0) AS score FROM a FULL JOIN b USING (review_id, section_no, doc_id)),
 h AS (SELECT *, row_number() OVER (PARTITION BY review_id, section_no ORDER BY score DESC, CASE WHEN sr IS NOT NULL AND dr IS NOT NULL THEN 1 ELSE 0 END DESC, doc_id) AS rank FROM f QUALIFY rank <= 6)
 SELECT review_id, section_no, source_index, rank, doc_id AS chunk_id, md5('[' || source_index || '] Paper ' || doc_id || ' (body)' || chr(10) || trim(text, ' ')) AS body_md5 FROM h JOIN src USING (review_id, doc_id) JOIN documents USING (doc_id)"""

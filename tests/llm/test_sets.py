"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup, merkle, ordered, resample
from tests_llm_helpers import random_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, best int, node int, Block int, kept int, position string"


def table(spark, texts, langs=("en", "de", None), ids=None):
    ids = ids or range(1, len(texts) + 1)
    rows = [(i, t, langs[k % len(langs)], None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), "x", 1, 2, 3, 4, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


EDGES = [None, "", " ", "A", "a", "É", "é", "word " * 20_000, "Same Text", "same text", "SAME TEXT", "日本", None]


# ---- 12


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, keep):
    texts = EDGES + random_texts(3, 40, copies=0) * 3 + ["Hot Passage"] * 200
    docs = table(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts, 1):
        groups[lowered(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.duplicates(docs, keep).collect()}
    assert len(got) == len(texts)
    for norm, ids in groups.items():
        stays = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (stays, len(ids), i == stays, hashlib.sha256(norm.encode()).hexdigest())
    left = exact_dedup.deduplicate(docs, keep)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted((max if keep == "largest" else min)(x) for x in groups.values())


def test_exact_duplicates_of_repeated_and_missing_ids(spark):
    docs = table(spark, ["x", "X", "x", "y", "y", "z", "z"], ids=[5, 5, None, None, None, None, 2])
    rows = exact_dedup.duplicates(docs).collect()
    assert sorted((r.text_sha256[:4], r.kept) for r in rows if r.kept) == sorted((hashlib.sha256(x).hexdigest()[:4], True) for x in (b"x", b"y", b"z"))
    assert {r.keep_id for r in rows if r.group_size == 3} == {5}
    assert [(r.doc_id, r.keep_id) for r in rows if r.kept and r.text_sha256 == hashlib.sha256(b"z").hexdigest()] == [(2, 2)]


def test_equal_digests_are_verified(spark):
    """Rows of one 64-bit digest that are not equal stay apart at every level."""
    rows = spark.range(64).select(F.col("id").alias("run"), F.lit(1).cast("long").alias("digest"), F.unhex(F.sha2((F.col("id") % 2).cast("string"), 256)).alias("check"), F.lit(1).alias("size"), F.struct(F.col("id"), F.col("id").alias("row")).alias("best"))
    levels = list(exact_dedup.rounds(rows))
    assert [x.agg(F.countDistinct("run")).first()[0] for x in levels] == [64, 8, 1]
    assert sorted((r.n, r.best.id) for r in levels[-1].collect()) == [(32, 62), (32, 63)]


def test_runs_are_kept_in_order(spark):
    docs = table(spark, random_texts(5, 60, copies=0))
    rows = exact_dedup._digests(docs.select("doc_id", "text"), True).select("doc_id", "run", *exact_dedup.SAME, "best")
    for level in exact_dedup.rounds(exact_dedup.durable(rows)):
        held = level.withColumn("file", F.input_file_name()).select("file", "run", "digest").collect()
        by_file = defaultdict(list)
        for r in held:
            by_file[r.file].append((r.run, r.digest))
        assert all(x == sorted(x) for x in by_file.values())


def test_exact_duplicates_of_nothing(spark):
    docs = table(spark, ["x"]).where("false")
    assert exact_dedup.duplicates(docs).collect() == [] and exact_dedup.deduplicate(docs).collect() == []
    with pytest.raises(TypeError):
        exact_dedup.duplicates(docs.withColumn("doc_id", F.lit("a")))
    with pytest.raises(ValueError):
        exact_dedup.duplicates(docs, "both")


# ---- 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes, proofs):
    """The root of a list of (hash, members); appends (left, right) of each level to the members' proofs."""
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j, (_, members) in enumerate(run):
                for m in members:
                    proofs[m].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((sha(*(h for h, _ in run)), [m for _, ms in run for m in ms]))
        nodes = above
    return nodes[0]


def brute_manifest(rows):
    langs, proofs, out = defaultdict(list), defaultdict(list), {}
    for k, r in enumerate(rows):
        langs[r.lang].append(((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)), k))
    subroots, sub_of = [], {}
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        listed = sorted(langs[lang])
        root, members = tree([(key[2], [k]) for key, k in listed], proofs)
        subroots.append((root, members))
        sub_of.update(dict.fromkeys(members, root))
    root, _ = tree(list(subroots), proofs)
    for k, r in enumerate(rows):
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        at = leaf_of(r, lowered(r.text) if touched and r.text is not None else r.text)
        for left, right in proofs[k]:
            at = sha(left, at, right)
        out[k] = (r.doc_id, leaf_of(r, r.text), sub_of[k], root, sha(*(a + b for a, b in proofs[k])), at, at == root)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, ["en", "de"]), (600, ["en", "en", "en", "de", None, ""]), (90, [f"l{k}" for k in range(70)])])
def test_manifest(spark, n, langs):
    texts = (EDGES + random_texts(n, n, copies=0))[:n]
    docs = table(spark, texts, langs)
    got = merkle.verify(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(docs.collect())


def test_manifest_of_repeated_and_missing_ids(spark):
    docs = table(spark, ["x", "y", "X", "x", None, "z"] * 4, ["en", "de"], [3, 3, None, 1, None, 2] * 4)
    assert sorted((tuple(r) for r in merkle.verify(docs).collect()), key=str) == brute_manifest(docs.collect())


def test_manifest_of_nothing(spark):
    assert merkle.verify(table(spark, ["x"]).where("false")).collect() == []


def test_positions_of_a_group_in_many_tasks(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g")).repartition(6)
    got = ordered.numbered(rows, "g", ["v"]).collect()
    for g in "ab":
        mine = sorted((r.v, r.position, r.n) for r in got if r.g == g)
        assert [p for _, p, _ in mine] == list(range(len(mine))) and {n for _, _, n in mine} == {len(mine)}


# ---- 13


def words_of(text):
    out, held = [], b""
    for c in lowered(text).encode() + b" ":
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            held += bytes([c])
        elif held:
            out.append(held)
            held = b""
    return out


def features_of(text, buckets):
    w = words_of(text)
    return [zlib.crc32(f) % buckets for f in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]


def brute_resample(docs, target, buckets, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features_of(text, buckets))
    for text in target:
        t.update(features_of(text, buckets))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features_of(text, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    able = sorted((r for r, (_, text) in zip(rows, docs, strict=True) if len(words_of(text)) >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("start", [1, 2**40, -70])
def test_resample(spark, start):
    texts = EDGES + ["A-b c" * 1000, "x" * 3000 + " y"] + random_texts(11, 120, words=80)
    docs = [(start + 3 * k, t) for k, t in enumerate(texts)]
    target = random_texts(12, 20, words=30) + [None, ""]
    frame = table(spark, texts, ids=[i for i, _ in docs])
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets=500)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = brute_resample(docs, target, 500)
    assert sorted(tuple(r) for r in got.collect()) == want
    drawn = resample.draw(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets=500)
    assert sorted((r["doc_id"], r["rank"]) for r in drawn.collect()) == sorted((r[0], r[4]) for r in want if r[4])
    assert drawn.columns == [*frame.columns, "weight", "score", "rank"]


def test_radix_ranks_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randint(-50, 50), rng.randint(-(2**62), 2**62)]), rng.choice([5, 5, 5, -9, rng.randint(-30_000, 30_000)])) for _ in range(900)]
    got = resample.radix_ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(5), digit_bits=9).collect()
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows, key=order)
    assert sorted(r.rank for r in got) == list(range(1, 901))


def test_one_digit_for_all_rows_is_split_by_blocks(spark):
    rows = spark.range(5000).select(F.col("id").alias("position"), F.lit(1).alias("v"))
    moved = resample.counting_sort(rows, F.col("v"), 512)
    assert moved.where("position < 0 OR position >= 5000").count() == 0 and moved.select("position").distinct().count() == 5000


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    docs = table(spark, ["x"])
    assert resample.resample(docs.where("false"), none).collect() == []
    assert [tuple(r) for r in resample.resample(docs, none, buckets=10).collect()][0][:2] == (1, 1)
    missing = resample.resample(table(spark, ["w " * 30] * 4, ids=[None, None, 4, 5]), none, percent=100, buckets=10).collect()
    assert sorted(r.rank for r in missing) == [1, 2, 3, 4]



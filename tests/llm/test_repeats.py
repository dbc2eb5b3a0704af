"""Operators 4, 6 and 10 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import byte_buckets, byte_cnn, decontaminate, line_winnow, secret_scan, suffix_trees
from tests_llm_helpers import SCHEMA, random_texts, rows_of


def brute_windows(docs, depth=13):
    first = {}
    for i, t in sorted(docs):
        w = t.split()
        for k in range(len(w) - depth + 1):
            first.setdefault(tuple(w[k : k + depth]), i)
    out = {}
    for i, t in docs:
        w = t.split()
        gone = set()
        for k in range(len(w) - depth + 1):
            if first[tuple(w[k : k + depth])] < i:
                gone.update(range(k, k + depth))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(docs, length=200):
    places = defaultdict(int)
    for _, t in docs:
        b = t.encode()
        for k in range(len(b) - length + 1):
            places[b[k : k + length]] += 1
    out = {}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if places[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_lines(docs, run=3):
    first = {}
    content = {i: [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for i, t in docs}
    for i, _ in sorted(docs):
        for k in range(len(content[i]) - run + 1):
            first.setdefault(tuple(content[i][k : k + run]), (i, k))
    out = {}
    for i, t in docs:
        lines, gone = content[i], set()
        for k in range(len(lines) - run + 1):
            if first[tuple(lines[k : k + run])] < (i, k):
                gone.update(range(k, k + run))
        kept, at = [], -1
        for x in t.split("\n"):
            blank = not x.strip(" \t\n\v\f\r")
            at += not blank
            if blank or at not in gone:
                kept.append(x)
        out[i] = (len(lines), len(gone), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(make, seed):
    docs = list(enumerate(random_texts(seed, 60), 1))
    got = {r[0]: tuple(r)[1:] for r in suffix_trees.digest(make([t for _, t in docs])).collect()}
    assert got == brute_windows(docs)


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_strings(make, seed):
    docs = list(enumerate(random_texts(seed, 60, words=120), 1))
    docs += [(len(docs) + 1, "ab" * 400), (len(docs) + 2, "z" * 205)]  # repeats of itself
    got = {r[0]: tuple(r)[1:] for r in byte_buckets.digest(make([t for _, t in docs])).collect()}
    assert got == brute_bytes(docs)


@pytest.mark.parametrize("seed", [5, 6])
def test_line_runs(make, seed):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(1, 60)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_winnow.dedup_lines(make([t for _, t in docs])).collect()}
    assert got == brute_lines(docs)


def brute_rich_lines(docs, run=3, words=30):
    """Like brute_lines, and runs of fewer lines that hold `words` words."""
    first = {}
    content = {i: [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for i, t in docs}
    wide = {}
    for i, lines in sorted(content.items()):
        wide[i] = [(k, n) for k in range(len(lines)) for n in range(1, run + 1) if k + n <= len(lines) and (n == run or sum(len(x.split()) for x in lines[k : k + n]) >= words)]
        for k, n in wide[i]:
            first.setdefault(tuple(lines[k : k + n]), (i, k))
    out = {}
    for i, t in docs:
        gone = {p for k, n in wide[i] if first[tuple(content[i][k : k + n])] < (i, k) for p in range(k, k + n)}
        kept, at = [], -1
        for x in t.split("\n"):
            blank = not x.strip(" \t\n\v\f\r")
            at += not blank
            if blank or at not in gone:
                kept.append(x)
        runs = sum(k - 1 not in gone for k in gone)
        out[i] = (len(content[i]), len(gone), runs, "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_runs_of_one_or_two_lines(make, seed):
    """Documents of one line, lines of 29 and 30 words, and pairs that reach 30 only together."""
    rng = random.Random(seed)
    lines = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate([1, 5, 14, 15, 15, 16, 29, 29, 30, 31, 64])] + ["", " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) for _ in range(50)]
    docs = list(enumerate([*texts, lines[10], lines[10], f"{lines[3]}\n{lines[4]}", f"own\n{lines[3]}\n\n{lines[4]}", lines[6]], 1))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["text"]) for r in line_winnow.dedup_lines(make([t for _, t in docs])).collect()}
    assert got == brute_rich_lines(docs)
    fresh = {r["doc_id"]: r["n_removed"] for r in line_winnow.dedup_lines(make([lines[10], f"own\n{lines[10]}", lines[6], lines[6]])).collect()}
    assert fresh == {1: 0, 2: 1, 3: 0, 4: 0}


def test_hot_passage(make):
    """A passage in every text, each in its own surroundings."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))) + " " + passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(1, 80)]
    texts = [t for _, t in docs]
    assert {r[0]: tuple(r)[1:] for r in suffix_trees.digest(make(texts)).collect()} == brute_windows(docs)
    assert {r[0]: tuple(r)[1:] for r in byte_buckets.digest(make(texts)).collect()} == brute_bytes(docs)


def test_many_texts_of_one_id(spark):
    """Thousands of different texts without an id, or with the same one: each gets its own hits."""
    rng = random.Random(10)
    passage = " ".join(f"p{k}" for k in range(60))
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [" ".join([word() for _ in range(rng.randint(1, 30))] + [passage] * (k % 2) + [word() for _ in range(rng.randint(1, 30))]) for k in range(3000)]
    without = spark.createDataFrame([(None, *r[1:]) for r in rows_of(texts)], SCHEMA).repartition(3)
    assert Counter(tuple(r)[1:] for r in byte_buckets.digest(without).collect()) == Counter(brute_bytes(list(enumerate(texts))).values())
    same = spark.createDataFrame([(1, *rows_of([passage])[0][1:]), *((5, *r[1:]) for r in rows_of(texts))], SCHEMA).repartition(3)
    want = Counter([brute_windows([(1, passage)])[1], *(brute_windows([(1, passage), (5, t)])[5] for t in texts)])  # texts of one id never remove each other
    assert Counter(tuple(r)[1:] for r in suffix_trees.digest(same).collect()) == want


@pytest.mark.parametrize("width", [8, 24, 40, 200])
def test_refinement_finds_equal_rows(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 50, 400):
        rows = rng.integers(97, 99, (n, width)).astype(np.uint8)
        for k in range(0, n - 1, 3):
            rows[k + 1] = rows[k]
            if k % 2:
                rows[k + 1, rng.integers(width)] ^= 1
        seen = Counter(r.tobytes() for r in rows)
        assert byte_buckets.refined(rows).tolist() == [seen[r.tobytes()] > 1 for r in rows]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("size", [256, 512, 1024, 2048])
def test_arrangements_that_cancel_out(make, size):
    """Words and byte strings whose sums of powers modulo 2**64 are equal, though they differ everywhere."""
    one, two = thue_morse(size), thue_morse(size, "b", "a")
    words = [" ".join([*(f"c{k}" for k in range(12)), w]) for w in (one, two)]
    assert [r["n_removed"] for r in suffix_trees.digest(make(words)).orderBy("doc_id").collect()] == [0, 0]
    docs = list(enumerate([f"x{one}y", f"z{two}w", f"{thue_morse(size, 'cd', 'dc')}q"], 1))
    assert {r[0]: tuple(r)[1:] for r in byte_buckets.digest(make([t for _, t in docs])).collect()} == brute_bytes(docs)


def test_column_names_and_ids(spark, make):
    """Columns named like an operator's own, in any case, and ids that are no integers."""
    odd = {"__rp_hits": 7, "__RP_ID": 7, "__lw_doc": 7, "N_LINES": 7, "N_Words": 7, "SECRETS": 7, "__aside_0": 7, "Hit_Words": 7, "SCORE": 7}
    docs = make(["same old line\n" * 3, "same old line\n" * 3, "password=abcdefghijklmnop"]).withColumns({c: F.lit(x) for c, x in odd.items()})
    items = spark.createDataFrame([(1, "same old line")], "item_id long, text string")
    for f, own in (
        (suffix_trees.remove_repeats, ()), (byte_buckets.remove_repeats, ()), (line_winnow.dedup_lines, ("n_lines", "n_removed", "n_runs")), (secret_scan.find_secrets, ("secrets",)),
        (lambda d: decontaminate.find_contamination(d, items), ("n_words", "hit_words", "items", "hit_offsets")), (lambda d: byte_cnn.score(d, None), ("score",)),
    ):
        out = f(docs)
        assert out.columns == [c for c in docs.columns if c.lower() not in own] + list(own)
        kept = [c for c in odd if c.lower() not in own]
        assert all(r[c] == 7 for r in out.collect() for c in kept)
    names = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for f in (suffix_trees.digest, byte_buckets.digest):
        with pytest.raises(TypeError):
            f(names)


def test_very_long_rows(make):
    """A text of 200,000 lines and one of 60,000 secrets take time in proportion."""
    lines = "\n".join(f"line {k % 90_000}" for k in range(200_000))
    out = line_winnow.dedup_lines(make([lines])).first()
    assert out["n_lines"] == 200_000 and out["n_removed"] == 110_000 and out["n_runs"] == 1
    text = " ".join(f"user=u{k:05d} token=abcdef{k % 10}" for k in range(60_000))
    found = secret_scan.find_secrets(make([text])).select(F.size("secrets").alias("n")).first()
    assert found["n"] == 120_000


def test_edges(edge_docs, no_docs):
    n = edge_docs.count()
    for f in (suffix_trees.digest, byte_buckets.digest):
        assert f(edge_docs).count() == n
        assert f(no_docs).count() == 0
    for f in (suffix_trees.remove_repeats, byte_buckets.remove_repeats, line_winnow.dedup_lines):
        out = f(edge_docs)
        assert out.count() == n and set(edge_docs.columns) <= set(out.columns)
        assert f(no_docs).count() == 0
    words = {r["doc_id"]: r for r in suffix_trees.digest(edge_docs).where("doc_id is not null").collect()}
    assert words[1]["n_words"] == 0 and words[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert words[7]["n_removed"] == 0  # its windows repeat only within itself
    own = {r["doc_id"]: r["n_removed"] for r in byte_buckets.digest(edge_docs).where("doc_id is not null").collect()}
    assert own[6] == 50_000 and own[7] == 25_000


def test_removed_text(make):
    passage = " ".join(f"p{k}" for k in range(20))
    out = {r["doc_id"]: r["text"] for r in suffix_trees.remove_repeats(make([passage, f"start {passage} end"])).collect()}
    assert out == {1: passage, 2: "start end"}


@pytest.mark.parametrize("pair", [("2bd92e", "475585"), ("458b12", "47a748"), ("3ceb2", "28367b"), ("29f035", "2b6654")])
def test_windows_that_differ_in_one_word_stay(make, pair):
    """Words whose hashes share 40 bits: records of one template are no repeats."""
    same = " ".join(f"field{k}" for k in range(12))
    rows = suffix_trees.digest(make([f"{same} {w}" for w in pair])).collect()
    assert [r.n_removed for r in rows] == [0, 0]

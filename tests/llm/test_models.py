"""Operators 2, 7 and 8, and the pipeline."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests_llm_helpers import random_texts

import corpus_pipeline
from inkwell.llm import byte_cnn, components, order_minhash, packing, repeats


def test_chunks_cover_every_byte():
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.random.default_rng(1).integers(1, 255, offsets[-1]).astype(np.uint8)
    chunks, first = byte_cnn.cut(data, offsets)
    for row, n in enumerate(sizes):
        own = chunks[first[row] : first[row + 1] if row + 1 < len(first) else None]
        back = np.zeros(n, np.uint8)
        for k, c in enumerate(own):
            part = back[k * byte_cnn.STRIDE : k * byte_cnn.STRIDE + byte_cnn.CHUNK]
            part[:] = c[: len(part)]
            assert not c[len(part) :].any()
        assert (back == data[offsets[row] : offsets[row + 1]]).all()


def test_classifier_learns(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randint(30, 200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i, _ in rows], "doc_id long, quality int")
    scored = byte_cnn.score(docs, byte_cnn.train(docs, labels)).where(byte_cnn.held_out()).collect()
    assert len(scored) > 20
    assert all((r["score"] >= byte_cnn.THRESHOLD) == (r["doc_id"] < len(good)) for r in scored)


def test_classifier_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.train(edge_docs, none) is None
    assert {r["score"] for r in byte_cnn.score(edge_docs, None).collect()} == {0.5}
    model = byte_cnn.fresh(1)
    out = byte_cnn.score(edge_docs, model)
    assert out.count() == edge_docs.count() and byte_cnn.score(no_docs, model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in out.collect())


def brute_score(model, data):
    """The forward pass in plain loops: chunks, filters at every HOP bytes, maxima, maximum and mean, one probability."""
    n = max(1, -(-(len(data) - (byte_cnn.CHUNK - byte_cnn.STRIDE)) // byte_cnn.STRIDE))
    vectors = []
    for k in range(n):
        chunk = data[k * byte_cnn.STRIDE : k * byte_cnn.STRIDE + byte_cnn.CHUNK]
        chunk = chunk + bytes(byte_cnn.CHUNK - len(chunk))
        windows = [np.concatenate([model.embed[b] for b in chunk[at : at + byte_cnn.WIDTH]]) for at in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.HOP)]
        vectors.append([max(0.0, max(float(w @ model.kernel[:, f]) for w in windows) + float(model.bias[f])) for f in range(byte_cnn.FILTERS)])
    v = np.array(vectors)
    logit = float(np.concatenate([v.max(axis=0), v.mean(axis=0)]) @ model.dense + model.offset)
    return 1 / (1 + np.exp(-logit))


def test_forward_pass_against_loops():
    rng = np.random.default_rng(3)
    model = byte_cnn.fresh(5)
    for size in (0, 1, 511, 513, 1500):
        data = rng.integers(0, 255, size).astype(np.uint8)
        got = byte_cnn.score_block(model, data, np.array([0, size]))
        assert abs(float(got[0]) - brute_score(model, data.tobytes())) < 1e-4


def test_slopes_against_differences():
    rng = np.random.default_rng(4)
    model = byte_cnn.fresh(9)
    sizes, labels, weight = np.array([1, 3, 2]), np.array([0, 1, 1]), np.array([1.5, 0.75], np.float32)
    chunks = rng.integers(60, 90, (6, byte_cnn.CHUNK)).astype(np.uint8)
    _, slopes = byte_cnn.loss_and_slopes(model, chunks, sizes, labels, weight)
    wide = byte_cnn.Model(*(np.asarray(getattr(model, k), np.float64) for k in ("embed", "kernel", "bias", "dense", "offset")))
    for name in ("embed", "kernel", "bias", "dense", "offset"):
        values = getattr(wide, name)
        for place in np.argsort(-np.abs(np.ravel(slopes[name])))[:6]:
            losses = []
            for step in (1e-4, -1e-4):
                moved = values.copy()
                moved.reshape(-1)[place] += step
                other = byte_cnn.Model(**{**wide.__dict__, name: moved})
                losses.append(brute_loss(other, chunks, sizes, labels, weight))
            assert abs((losses[0] - losses[1]) / 2e-4 - np.ravel(slopes[name])[place]) < 2e-3 * max(1.0, abs(np.ravel(slopes[name])[place])), (name, place)


def brute_loss(model, chunks, sizes, labels, weight):
    total, at = 0.0, 0
    for n, y in zip(sizes, labels, strict=True):
        rows = np.stack([[np.concatenate(model.embed[c[k : k + byte_cnn.WIDTH]]) for k in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.HOP)] for c in chunks[at : at + n]])
        v = np.maximum((rows @ model.kernel).max(axis=1) + model.bias, 0)
        p = 1 / (1 + np.exp(-(np.concatenate([v.max(axis=0), v.mean(axis=0)]) @ model.dense + float(model.offset))))
        total -= weight[y] / len(sizes) * np.log(p if y else 1 - p)
        at += n
    return total


def test_gradient_step_lowers_loss():
    rng = np.random.default_rng(2)
    chunks = rng.integers(97, 122, (40, byte_cnn.CHUNK)).astype(np.uint8)
    chunks[20:] -= 32
    labels = np.array([1] * 20 + [0] * 20)
    model = byte_cnn.fit(chunks, np.arange(40), labels)
    scores = np.concatenate([byte_cnn.score_block(model, c, np.array([0, len(c)])) for c in chunks])
    assert ((scores >= 0.5) == labels).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 30), max_size=60), st.integers(1, 40))
def test_plan_places_everything(histogram, groups):
    plan = packing.Plan(histogram, 4096, groups)
    ranks, bins = {}, {}
    for length, rank, number, first, offset in plan.segments:
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + number
        for k in range(number):
            bins.setdefault(first + k, []).append((offset, length))
    assert ranks == histogram and set(bins) == set(range(plan.sequences))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    rooms = []  # first fit of the longest: the plan may lose at most one group of large pieces against it
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = next((k for k, r in enumerate(rooms) if r >= n), None)
        if fit is None:
            rooms.append(4096 - n)
        else:
            rooms[fit] -= n
    large = sum(c for n, c in histogram.items() if 8 * n > 4096)
    assert plan.sequences <= len(rooms) * 1.25 + -(-large // groups)


def test_packing_round_trip(spark, make, edge_docs, no_docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    texts = random_texts(21, 40, words=300) + ["Don't STOP, it's <|endoftext|> 'x' 12.5% ÀÉ, é İ ΑΣ ﬁ \x1c\x85 a b 한국어", "word " * 9000, None, ""]
    got = packing.pack(make(texts)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts, 1):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 4096))
        for r in parts:
            piece = np.array(ids[r["start"] : r["start"] + 4096], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(piece), zlib.crc32(piece.tobytes()))
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(used) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(edge_docs).select("doc_id").count() >= edge_docs.count()
    assert packing.pack(no_docs).count() == 0


def brute_classes(docs):
    shingles = {i: t.split() for i, t in docs if t and t.split()}
    parent = {i: i for i in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(shingles)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = shingles[a], shingles[b]
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
                continue
            for p in range(len(x)):
                for q in range(len(y)):
                    table[p + 1][q + 1] = table[p][q] + 1 if x[p] == y[q] else max(table[p][q + 1], table[p + 1][q])
            long = table[-1][-1]
            if long / (len(x) + len(y) - long) >= 0.8 - 1e-9:
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in shingles}


def near_texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(6, 90))] for _ in range(8)]
    out = []
    for _ in range(70):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [words[k], rng.choice(vocab)]])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(make, seed):
    texts = near_texts(seed)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(make(texts)).collect() if r["class_id"] is not None}
    assert got == brute_classes(list(enumerate(texts, 1)))


def test_long_words_and_texts_that_only_look_alike(make):
    """Thue-Morse arrangements, which sums of powers modulo 2**64 cannot tell apart."""

    def arranged(a, b, n):
        return [b if bin(k).count("1") % 2 else a for k in range(n)]

    context = [f"w{k}" for k in range(6)]
    words = ["".join(arranged(x, y, 2048)) for x, y in (("a", "b"), ("b", "a"))]
    texts = [" ".join([*context[:3], w, *context[3:]]) for w in words]
    texts += [" ".join(arranged(x, y, 2048)) for x, y in (("one", "two"), ("two", "one"))]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(make(texts)).collect()}
    assert got[1] != got[2]  # 6 of 8 words are equal: too few
    assert len(set(order_minhash._words(" ".join(words).encode()).tolist())) == 2


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(400):
        a = [rng.randint(0, rng.choice([2, 5, 30])) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [rng.randint(0, 5)], [b[k], 1]])
            b = b or [1]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p, x in enumerate(a):
            for q, y in enumerate(b):
                table[p + 1][q + 1] = table[p][q] + 1 if x == y else max(table[p][q + 1], table[p + 1][q])
        least = 0.8 * (len(a) + len(b)) / 1.8 - 1e-9
        want = table[-1][-1] if table[-1][-1] >= least else 0
        assert order_minhash.alignment(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        order_minhash.near_duplicate_classes(spark.createDataFrame([("x", "some text")], "doc_id string, text string"))


def test_near_duplicate_edges(edge_docs, no_docs):
    out = order_minhash.near_duplicate_classes(edge_docs)
    assert out.count() == edge_docs.count() and order_minhash.near_duplicate_classes(no_docs).count() == 0
    got = {r["doc_id"]: r["class_id"] for r in out.collect() if r["doc_id"] is not None}
    assert got[1] is None and got[2] is None and got[4] is None
    assert got[8] == got[9] == 8 and got[5] == 5


def test_sketch_of_equal_order():
    words = np.arange(1, 400, dtype=np.uint64) * np.uint64(2654435761)
    a = order_minhash.sketches(order_minhash.labelled_shingles(words))
    b = order_minhash.sketches(order_minhash.labelled_shingles(np.concatenate([words[200:], words[:200]])))
    assert len(a) == order_minhash.SKETCHES and (a == b).mean() < 0.7  # the same shingles, half of the pairs in another order
    assert (order_minhash.sketches(order_minhash.labelled_shingles(words), pick=8) == order_minhash.sketches(order_minhash.labelled_shingles(np.concatenate([words[200:], words[:200]])), pick=8)).mean() < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["u"]: r["v"] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100}


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(12))
    good = ["\n".join(line() for _ in range(8)) for _ in range(120)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:50]]
    question = line()
    shared = [line() for _ in range(4)]
    special = [good[0] + " extra", f"{good[1]}\n{question}", "\n".join([line(), *shared, line()]), "\n".join([line(), *shared, line()])]
    texts = good + bad + special
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120)) for i in range(170)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.durable(stage(spark, now, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns
    kept = set(seen["quality"])
    assert len(kept & set(range(120))) >= 118 and len(kept & set(range(120, 170))) <= 2
    assert seen["line_dedup"][173]["text"].split("\n") == [texts[173].split("\n")[0], texts[173].split("\n")[-1]]
    assert 170 not in seen["line_dedup"] or 170 not in seen["near_dedup"] or seen["line_dedup"][170]["text"] != texts[170]
    assert 171 not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_odd_tables(spark, tmp_path, edge_docs, no_docs):
    """Nulls, repeated rows and columns named as the operators' own come through every stage."""
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = edge_docs.withColumns({c: F.lit(7) for c in ("score", "n_words", "n_lines", "n_removed", "hit_words", "class_id", "length", "piece", "label")})
    for docs in (odd, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                assert all(r["n_words"] == 7 and r["score"] == 7 for r in out.collect()) if docs is odd else out.count() == 0
            else:
                assert out.count() >= docs.count()


def test_word_rows_do_not_cross():
    data = np.frombuffer(b"ab cd" + b"ef gh", np.uint8)
    _, at = repeats.word_rows(data, np.array([0, 5, 5, 10]))
    assert at.tolist() == [0, 2, 2, 4]


def test_held_out_rule(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", byte_cnn.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("short,few,rows", [(0, -1, 1), (0, -1, 3), (0, 10**9, 2048), (0, 24, 2048), (8192, 24, 2048)])
def test_alignment_all_ways(monkeypatch, short, few, rows):
    """One number, single matches and rows in hand all give the longest common subsequence within the band."""
    monkeypatch.setattr(order_minhash, "SHORT", short)
    monkeypatch.setattr(order_minhash, "FEW_MATCHES", few)
    monkeypatch.setattr(order_minhash, "_ROWS", rows)
    rng = random.Random(few + rows)
    for _ in range(60):
        vocabulary = rng.choice([2, 5, 100])
        a = [rng.randrange(vocabulary) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(vocabulary) for _ in range(rng.randint(0, 4))]
        band = rng.choice([0, 1, 4, 100])
        best = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            before = best[:]
            for j, y in enumerate(b):
                best[j + 1] = max(before[j] + 1 if x == y and abs(i - j) <= band else 0, before[j + 1], best[j])
        assert order_minhash._common(a, b, band) == best[-1]


def test_long_pairs_follow_the_band():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**62, 300_000).astype(np.uint64)
    b = a.copy()
    b[rng.random(len(b)) < 0.05] = 7
    began = time.time()
    assert order_minhash.similarity(a, b) > 0.89 and time.time() - began < 4


def test_hot_buckets_change_nothing(spark, make):
    """The rows of buckets are the same whether many texts' buckets are kept out of the shuffle or not."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = [" ".join(x if rng.random() > 0.02 else f"v{rng.randrange(9)}" for x in base) for _ in range(150)] + [f"other text {k} of its own" for k in range(20)]
    docs = make(texts).select("doc_id", "text")
    kept = docs.mapInArrow(order_minhash._sketch, order_minhash._NODE).cache()
    hot = order_minhash._hot_buckets(kept, sample=1, many=64, most=1000)
    assert len(hot) > 5
    rows = lambda x: sorted((r.b, r.id, r.c.id) for r in x.collect())
    assert rows(order_minhash._bucketed(kept, hot)) == rows(order_minhash._bucketed(kept, []))


def test_candidates_miss_no_pair_of_the_table(spark):
    """Recall against all pairs of the smallest table: every two texts that align at 0.8 are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    label = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()}
    words = {r.doc_id: order_minhash._words(r.text.encode()) for r in docs.collect()}
    ids, pairs, lost = sorted(k for k, w in words.items() if len(w)), 0, 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 0.8 * max(len(words[a]), len(words[b])) <= min(len(words[a]), len(words[b])) and order_minhash.similarity(words[a], words[b]) >= 0.8 - 1e-9:
                pairs += 1
                lost += label[a] is None or label[a] != label[b]
    assert pairs > 0 and lost == 0


def test_texts_around_a_passage_meet_by_component_not_by_bucket(spark, make):
    rng = random.Random(12)
    word = lambda kind, n: f"{kind}{rng.randrange(n)}"
    passage = [word("p", 10**6) for _ in range(150)]
    around = lambda n: [" ".join([word("a", n) for _ in range(35)] + passage + [word("z", n) for _ in range(35)])]
    copied = around(400)[0].split()
    texts = [" ".join(x if k % 40 != n % 40 else f"v{n}" for k, x in enumerate(copied)) for n in range(40)]  # near copies: one component
    texts += [t for _ in range(60) for t in around(400)]  # too far from these and from each other
    texts += [" ".join([*t.split()[:-2], "other", "end"]) for t in texts[40::6]]  # each a link to one of the 60
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(make(texts)).collect()}
    assert got == {i: 1 if i <= 40 else i if i <= 100 else 41 + 6 * (i - 101) for i in range(1, len(texts) + 1)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    made = {"Join": 0, "posexplode": 0}
    for k in range(before, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(k).executionId()), store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            kind = "posexplode" if "posexplode" in node.desc() else "Join" if "Join [id#" in node.desc() and node.desc().count("[id#") == 2 else None
            for m in map(node.metrics().apply, range(node.metrics().size())) if kind else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made[kind] = max(made[kind], int(values.apply(m.accumulatorId()).replace(",", "")))
    assert made["posexplode"] > 500  # rare words of the texts outside
    assert made["Join"] <= 6 * made["posexplode"]  # a text outside is so by a few components, but shares about 20 buckets with others


def test_workers_give_memory_back_after_a_task():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024  # noqa: E731, SIM115
    run = packing._tokenise(packing.default_tokenizer(), packing.CAPACITY)
    word = lambda k: str(k).translate({48 + d: c for d, c in enumerate("etaoinshrd")})
    batch = lambda a, b: pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(map(word, range(a, b)))]})
    assert len(list(run(iter([batch(0, 1000)])))) == 1
    before = resident()
    assert sum(b.num_rows for b in run(batch(k, k + 200_000) for k in (10**6, 2 * 10**6, 3 * 10**6))) > 100
    assert resident() - before < 60


def test_small_components_are_one_file(spark, monkeypatch):
    monkeypatch.setattr(components, "ROWS_A_FILE", 1000, raising=False)
    links = spark.range(1, 600).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 20).alias("b")).repartition(4)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = components.components(links)
        assert len(out.inputFiles()) == 1 and {(r.u, r.v) for r in out.collect()} == {(i, i - i % 20) for i in range(1, 600) if i % 20}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

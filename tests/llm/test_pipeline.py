"""The pipeline as a whole against its stages in plain loops."""

import random
import zlib

import numpy as np
from test_models import brute_classes, brute_score
from test_repeats import brute_rich_lines
from test_scans import brute_hits

import corpus_pipeline
from inkwell.llm import byte_cnn, packing


def corpus():
    """Prose, junk, shared lines, exact and near copies, and texts with a benchmark passage."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    prose = ["\n".join(line(rng.randint(6, 14)) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    junk = ["\n".join(line(8).upper().replace(" ", "!! ") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    passage, question = line(40), line(12)
    special = [prose[3], prose[3], f"{line(9)}\n{passage}\n{line(9)}", f"{line(7)}\n{passage}\n{line(8)}", f"{prose[7]}\n{question}", question.upper()]
    for k in range(10, 16):  # near copies: one or two words of a text are others
        words = prose[k].split(" ")
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = word()
        special.append(" ".join(words))
    texts = prose + junk + special
    rng.shuffle(texts)
    return texts, {t for t in junk}, question


def test_whole_pipeline_against_loops(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, junk, question = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(t not in junk)) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question), (2, "none of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = byte_cnn.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {i: t for i, t, *_ in rows if brute_score(model, t.encode()) >= byte_cnn.THRESHOLD}
    cut = brute_rich_lines(sorted(left.items()))
    left = {i: cut[i][3] for i in left if cut[i][1] == 0 or cut[i][1] < cut[i][0]}
    classes = brute_classes(sorted(left.items()))
    left = {i: t for i, t in left.items() if classes.get(i, i) == i}
    left = {i: t for i, t in left.items() if not brute_hits(t, [(1, question), (2, "none of them")])[1]}
    assert 40 < len(left) < len(texts) - 30

    coder = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, t in left.items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4")
        for k in range(0, len(ids), packing.CAPACITY):
            piece = ids[k : k + packing.CAPACITY]
            want[i, k // packing.CAPACITY] = (k, len(piece), zlib.crc32(piece.tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(places) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1

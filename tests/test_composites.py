"""Reviews with retrieval for each section, and experiments of whole papers."""

from pyspark.sql import functions as F

from inkwell.operators import composites, index, library, retrieval, vector_index


def test_reviews(spark, tmp_path):
    texts = {1: "Graphs store nodes. They are old.", 2: "Trees are graphs without cycles. Fine.", 3: "Hash tables store keys. Indeed.", 4: "Graphs of another review. Yes."}
    docs = spark.createDataFrame([(k, k, t, "intro" if k == 1 else "") for k, t in texts.items()], "chunk_id long, paper_id long, content string, section_path string")
    k, v = str(tmp_path / "k"), str(tmp_path / "v")
    index.add(docs, k, "chunk_id", "content")
    vector_index.index_chunks(docs, v, lambda rows: retrieval.hash_vectors(rows, "content"), "chunk_id", "content", cells=2)
    papers = spark.createDataFrame([(k, f"Paper {k}", 2000 + k) for k in texts], "paper_id long, title string, published_year int")
    reviews = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 4)], "review_id string, paper_id long")
    sources = composites.sources_of(reviews, papers)
    assert sorted(map(tuple, sources.collect())) == [("a", 1, 3, "Paper 3"), ("a", 2, 2, "Paper 2"), ("a", 3, 1, "Paper 1"), ("b", 1, 4, "Paper 4")]
    sections = spark.createDataFrame([("a", 0, "graphs", "Overview", "nodes"), ("a", 1, "hash tables", "Keys", ""), ("b", 0, "graphs", "Overview", ""), ("c", 0, "graphs", "Nothing", "")], "review_id string, section_no int, topic string, heading string, focus string")
    passages = composites.section_passages(spark, k, v, sections, sources, docs, 2)
    found = {}
    for r in passages.collect():
        found.setdefault((r.review_id, r.section_no), {})[r["rank"]] = (r.source_index, r.body)
    assert found["a", 0][1] == (3, "[3] Paper 1 (intro)\nGraphs store nodes. They are old.")
    assert found["a", 1][1] == (1, "[1] Paper 3 (body)\nHash tables store keys. Indeed.")
    assert set(found["b", 0]) == {1} and found["b", 0][1][0] == 1 and ("c", 0) not in found  # no section sees another review's papers
    texts_ = spark.createDataFrame([("a", 0, "Graphs have nodes [3] and [1] and [9]. "), ("b", 0, None)], "review_id string, section_no int, text string")
    made = {r.review_id: r.markdown for r in composites.literature_reviews(sections, sources, passages, texts_).collect()}
    assert made["a"].startswith("## Overview\n\nGraphs have nodes [3] and [1] and [9].\n\n## Keys\n\nThis section could not be generated.")
    given = {r.section_no: r.available for r in composites.drafted(sections, passages, texts_).where("review_id = 'a'").collect()}
    assert made["a"].endswith("## References\n\n" + "\n".join(f"{i}. Paper {4 - i}" for i in (1, 3) if i in given[0]))
    assert "This section could not be generated." in made["b"] and composites.NOTHING in made["c"]
    extracted = {(r.review_id, r.section_no): r.text for r in composites.extracted_passages(passages, sections).collect()}
    assert extracted["b", 0] == "Graphs of another review. [1]" and extracted["a", 0].startswith("Graphs store nodes. [3]")


def test_experiments(spark, tmp_path):
    papers = spark.createDataFrame([(1, "First " + "x" * 90, "We reach accuracy of 91.5% on SQuAD."), (2, "Second", None), (3, "Third", "")], "paper_id long, title string, abstract string")
    chunks = spark.createDataFrame([(1, 0, "Also F1 score of 80 on GLUE."), (1, 41, "BLEU of 12 is late."), (2, 0, "On CoNLL recall of 7."), (3, 0, "Nothing here.")], "paper_id long, chunk_index int, content string")
    rows = {(r.paper_id, r.metric): (r.model, r.value, r.dataset) for r in composites.experiments(papers, chunks, datasets=("squad", "glue")).collect()}
    assert rows == {(1, "accuracy"): (("First " + "x" * 90)[:80], 91.5, "squad"), (1, "f1"): (("First " + "x" * 90)[:80], 80.0, "squad"), (2, "recall"): ("Second", 7.0, None)}
    reply = '{"results": [{"model": "M", "metric": "acc", "value": "92", "dataset": "SQuAD"}, {"model": "M", "value": 3}]}'
    replies = spark.createDataFrame([(1, reply), (2, "not json")], "paper_id long, reply string")
    merged = composites.experiments(papers, chunks, replies, datasets=("squad", "glue"))
    assert sorted((r.paper_id, r.metric, r.model[:5], r.value) for r in merged.collect()) == [(1, "accuracy", "M", 92.0), (1, "f1", "First", 80.0), (2, "recall", "Secon", 7.0)]
    path = str(tmp_path / "r")
    composites.store_experiments(merged, papers, path)
    composites.store_experiments(merged.where("paper_id = 1 AND metric = 'f1'"), papers.where("paper_id < 3"), path)
    kept = library.stored(spark, path)
    assert [(r.paper_id, r.metric_key, r.dataset_key) for r in kept.collect()] == [(1, "f1", "squad")]  # paper 2 has none any more
    assert kept.where(F.col("model_key").startswith("first")).count() == 1


def test_only_texts_of_reviewed_papers_get_a_vector(spark, monkeypatch):
    import os

    import pytest

    from inkwell.plans import catalogue, standing
    from inkwell.operators import vector_index

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    embedded, index_chunks = [], vector_index.index_chunks
    monkeypatch.setattr(vector_index, "index_chunks", lambda chunks, *a, **b: embedded.append(chunks.count()) or index_chunks(chunks, *a, **b))
    monkeypatch.setattr(standing, "text_vectors", None)  # the index of all documents is not asked for
    assert catalogue._reviews(spark, "/root/testdata/sf0.01")[2].count() > 0
    assert len(embedded) == 1 and embedded[0] <= 20 * 40

"""Model replies as rows."""

import json

from inkwell.operators import payloads


def replies(spark, *texts, key="paper_id"):
    return spark.createDataFrame(list(enumerate(texts, 1)), f"{key} long, reply string")


def test_entities_and_relations(spark):
    body = {
        "entities": [{"type": "dataset", "name": " SQuAD ", "confidence": 3}, {"type": "Dataset", "name": "squad.", "confidence": 0.2}, {"type": "Planet", "name": "Mars"}, {"type": "Model", "name": ""}],
        "relations": [{"type": "uses_dataset", "source": "First", "target": "SQuAD"}, {"type": "LIKES", "source": "First", "target": "SQuAD"}, {"type": "USES_DATASET", "source": "First", "target": "MNIST"}],
    }
    rows = replies(spark, f"Here: ```json {json.dumps(body)}```", "not json")
    found = payloads.entities(rows)
    assert [(r["label"], r["entity_key"], r["name"], r["confidence"]) for r in found.collect()] == [("Dataset", "squad", "SQuAD", 1.0)]
    papers = spark.createDataFrame([(1, "First")], "paper_id long, title string")
    assert [tuple(r) for r in payloads.relations(rows, papers, found).collect()] == [("Paper:1", "USES_DATASET", "Dataset:squad")]


def test_results(spark):
    body = {"results": [{"model": "m", "metric": "F1-score", "value": "91.5", "confidence": "x"}, {"model": "m", "metric": "f1", "value": "high"}, {"metric": "f1", "value": 1}]}
    got = payloads.results(replies(spark, json.dumps(body), "{}")).collect()
    assert [(r["model"], r["metric"], r["value"], r["confidence"]) for r in got] == [("m", "f1", 91.5, 0.5)]


def test_methodology_gaps_judgements(spark):
    body = {"approach": "a", "hyperparameters": [{"name": "lr", "value": "0.1"}], "limitations": ["l"]}
    got = payloads.methodology(replies(spark, json.dumps(body), "{}", "x")).collect()
    assert [(r["paper_id"], r["approach"], r["hyperparameters"], r["limitations"]) for r in got] == [(1, "a", ["lr = 0.1"], ["l"])]
    gap = {"gaps": [{"gap": "g", "evidence_indices": [2, 2, 99, 1], "confidence": -1}, {"gap": " "}]}
    assert [(r["gap"], r["evidence"], r["confidence"]) for r in payloads.gaps(replies(spark, json.dumps(gap))).collect()] == [("g", [1, 2], 0.0)]
    judged = payloads.judgements(replies(spark, '{"relation": "Contradiction", "confidence": 0.8}', '{"relation": "maybe"}', "?", key="pair_id")).orderBy("pair_id").collect()
    assert [(r["relation"], r["confidence"]) for r in judged] == [("contradiction", 0.8), ("unrelated", 0.5), ("unrelated", 0.5)]


def test_outline_and_bibtex(spark):
    got = payloads.outline(replies(spark, '{"sections": [{"heading": "H", "focus": "F"}]}', "?", key="review_id")).orderBy("review_id", "section_no").collect()
    assert [r["heading"] for r in got] == ["H", "Overview", "Approaches", "Evaluation", "Open problems"]
    rows = spark.createDataFrame([(1, "Ann Lee; Bo Oh", 2020, "Deep things", "V"), (2, "Ann Lee", 2020, "Deep more", None)], "paper_id long, authors string, year int, title string, venue string")
    entries = [r["entry"] for r in payloads.bibtex(rows).orderBy("paper_id").collect()]
    assert entries[0].startswith("@article{") and "author = {Ann Lee and Bo Oh}" in entries[0] and "journal" not in entries[1]

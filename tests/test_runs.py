"""Judged claim pairs, consistency reports, and counters as batch and stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkwell.operators import consistency
from inkwell.sources import replacing
from inkwell.streaming import counters


@pytest.fixture()
def work(spark):
    stated = spark.createDataFrame([(p, n, f"claim {n} of paper {p}") for p in range(6) for n in range(1, 3)], "paper_id long, claim_no int, claim string")
    pairs = spark.createDataFrame([(a, 1, a + 1, 2, 0.5) for a in range(5)], "left_paper long, left_no int, right_paper long, right_no int, overlap double")
    return consistency.pair_work(pairs, stated)


def test_pairs_are_asked_once(spark, work, tmp_path):
    path, asked = str(tmp_path / "w"), []

    def judge(reply):
        def run(rows):
            asked.append(sorted(r.pair_key for r in rows.select("pair_key").collect()))
            return rows.withColumn("reply", reply)

        return run

    said = F.when(F.col("left_paper") < 2, '{"relation": "agreement", "confidence": 2}').when(F.col("left_paper") == 2, "not json")
    assert consistency.judge_pending(work, path, judge(said)) == 3  # two pairs got no reply
    assert consistency.pending(work, path).count() == 2
    told = {r.left_paper: (r.relation, r.confidence) for r in consistency.judged_pairs(work, path).collect()}
    assert told == {0: ("agreement", 1.0), 1: ("agreement", 1.0), 2: ("unrelated", 0.5), 3: (None, None), 4: (None, None)}
    assert consistency.judge_pending(work, path, judge(F.lit('{"relation": "contradiction"}'))) == 2
    assert consistency.judge_pending(work, path, judge(F.lit("x"))) == 0
    assert [len(a) for a in asked] == [5, 2] and set(asked[1]) == {"3/1/4/2", "4/1/5/2"}
    # A claim that changes is asked again; its old reply no longer counts.
    changed = work.withColumn("prompt_hash", F.when(F.col("left_paper") == 0, F.lit("other")).otherwise(F.col("prompt_hash")))
    assert [r.pair_key for r in consistency.pending(changed, path).collect()] == ["0/1/1/2"]
    row = consistency.judged_pairs(work, path).where("left_paper = 0").first()
    assert (row.left_claim, row.right_claim) == ("claim 1 of paper 0", "claim 2 of paper 1")


def test_a_judge_that_fails_loses_no_reply(spark, work, tmp_path):
    path = str(tmp_path / "w")
    consistency.judge_pending(work.where("left_paper = 1"), path, lambda rows: rows.withColumn("reply", F.lit('{"relation": "agreement"}')))
    with pytest.raises(Exception, match="broken"):
        consistency.judge_pending(work, path, lambda rows: rows.withColumn("reply", F.when(F.col("left_paper") == 3, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))))
    assert consistency.replies(spark, path).count() == 1 and replacing.has(spark, path)


def test_report(spark, work, tmp_path):
    path = str(tmp_path / "w")
    papers = spark.range(6).select(F.col("id").alias("paper_id"))
    ranges = spark.createDataFrame([(2,), (1,), (0,)], "n_above long")
    empty = consistency.report(ranges.limit(0), consistency.judged_pairs(work, path).limit(0), papers).first()
    assert empty.is_consistent and empty.summary == "No conflicts found across 6 papers."
    assert consistency.report(ranges.limit(0), consistency.judged_pairs(work, path), papers.limit(1)).first().summary.startswith("At least two papers")
    consistency.judge_pending(work, path, lambda rows: rows.withColumn("reply", F.when(F.col("left_paper") < 2, '{"relation": "contradiction"}').when(F.col("left_paper") == 2, '{"relation": "agreement"}')))
    row = consistency.report(ranges, consistency.judged_pairs(work, path), papers).first()
    assert (row.numeric_conflicts, row.contradictions, row.agreements, row.unjudged) == (3, 2, 1, 2)
    assert row.summary == "3 numeric conflict(s) and 2 contradicting claim(s) across 6 papers." and not row.is_consistent


# ---- counters

START = datetime(2024, 1, 1)


def made(seed=1, series=3, n=60):
    rng, rows = random.Random(seed), []
    for s in range(series):
        total = 5.0
        for k in range(n):
            total = float(rng.randint(0, 3)) if rng.random() < 0.08 else total + rng.randint(0, 4)
            rows.append((f"s{s}", START + timedelta(seconds=47 * k + s), total))
    return rows


def brute(rows):
    out, last = [], {}
    for s, ts, total in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(s)
        out.append((s, ts, 0.0 if before is None else total if total < before else total - before))
        last[s] = total
    return sorted(out)


def test_increases_undo_resets(spark):
    rows = made()
    got = counters.increases(spark.createDataFrame(rows, "series string, ts timestamp, total double"))
    assert sorted((r.series, r.ts, r.increase) for r in got.collect()) == brute(rows)
    rated = counters.rates(got).groupBy().agg(F.sum("increase")).first()[0]
    assert rated == sum(x for _, _, x in brute(rows))


def test_a_stream_of_counters_equals_the_batch(spark, tmp_path):
    rows, schema = made(2), "series string, ts timestamp, total double"
    ordered = sorted(rows, key=lambda r: r[1])
    want = brute(rows)
    for n, some in enumerate((ordered[:50], ordered[50:51], ordered[51:])):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = counters.increases(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (50, 51, len(rows))[n]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.series, r.ts, r.increase) for r in out.collect()) == want
    batch = counters.rates(counters.increases(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, counters.rates(out).collect())) == sorted(map(tuple, batch.collect()))


def test_bucket_quantiles(spark):
    at = lambda k: START + timedelta(seconds=k)
    inf = float("inf")
    first = [("a", le, at(0), 0.0) for le in (1.0, 2.0, inf)]
    then = [("a", 1.0, at(10), 10.0), ("a", 2.0, at(10), 30.0), ("a", inf, at(10), 40.0)]
    again = [("a", 1.0, at(400), 1.0), ("a", 2.0, at(400), 1.0), ("a", inf, at(400), 4.0)]  # after a reset
    grown = counters.increases(spark.createDataFrame(first + then + again, "stage string, le double, ts timestamp, total double"), ("stage", "le"))
    half = sorted((r.quantile for r in counters.bucket_quantiles(grown, 0.5).collect()))
    assert half == [1.5, 2.0]  # 20 of 40: half way into the second bucket; 2 of 4: beyond the last bound
    assert counters.bucket_quantiles(grown, 0.1).orderBy("window_start").first().quantile == 0.4
    assert counters.bucket_quantiles(grown.where("increase = 0"), 0.5).count() == 0


def test_spikes(spark):
    rows = [("a", START + timedelta(minutes=15 * k), float(10 * k if k < 60 else 10 * k + 500 * (k - 59))) for k in range(64)]
    grown = counters.increases(spark.createDataFrame(rows, "series string, ts timestamp, total double"))
    got = [r for r in counters.spikes(grown).orderBy("window_start").collect() if r.window_start >= START + timedelta(hours=7)]  # before, the baseline has less than its six hours
    assert [r.window_start for r in got] == [START + timedelta(minutes=15 * k) for k in range(60, 64)]

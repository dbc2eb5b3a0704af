"""Operator 13: importance resampling towards a target, ranked by a distributed LSD radix sort.

1. Features are the runs of 1 and 2 words of a text; each falls into one of
   BUCKETS buckets by its CRC-32.  One scan counts the buckets of the corpus
   and of the target (a task sends at most BUCKETS sums), and the gain of a
   bucket says how much more frequent it is in the target.  The gains are an
   array of BUCKETS numbers, whatever the size of the corpus.
2. A second scan scores every text by that array: its weight is the mean gain
   of its features.  A weight plus Gumbel noise, from a hash of the row's id,
   is a score of which the highest ones are a sample without replacement.
3. The scores are ranked by stable counting sorts of their composite key,
   least significant digit first: the digits of doc_id, then those of the
   score, of at most DIGIT_BITS bits.  A pass numbers the rows of each (block
   of positions, digit), sums the counts of smaller digits, and of equal
   digits in earlier blocks, to the place where each (block, digit) begins,
   and moves every row there.  So a task holds rows of a block, never all of
   a digit that most rows share; blocks grow with the root of the number of
   rows, as does the list of blocks of one digit.  The positions after the
   last pass are the ranks.

Defined results: a null text has no words; texts without words have weight 0;
texts under MIN_WORDS words are scored and never drawn; a row without an id
takes its noise from the empty id and comes after rows of equal scores that
have one; rows that repeat both score and id are ranked in table order; an
empty target or corpus counts as no features; other columns are not looked at
by resample(), and draw() gives them back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkwell.llm import textkit
from inkwell.llm.columns import aside, back
from inkwell.llm.durable import durable, release
from inkwell.llm.ordered import numbered

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
DIGIT_BITS = 12
LEAST_BLOCK = 4096
LONG_WORD = 256

_byte = np.arange(256)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
_BREAKS = (_byte < 128) & ~(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)))


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1).astype(np.uint32)
    return row


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of the stretches [start, end), each from its state before; a byte of all stretches at a time."""
    state, sizes = before.copy(), ends - starts
    at, k = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD)), 0
    while len(at):
        state[at] = _step(state[at], data[starts[at] + k])
        k += 1
        at = at[sizes[at] > k]
    full = 0xFFFFFFFF
    for i in np.flatnonzero(sizes > LONG_WORD):
        state[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]) ^ full) ^ full
    return state


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each word with the one before it or -1 where a row begins, word offsets of the rows)."""
    data = _LOWER[data]
    starts, ends, rows = textkit.word_spans(data, offsets, _BREAKS)
    fresh = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    word = crc_states(data, starts, ends, fresh)
    pair = np.full(len(starts), -1, np.int64)
    if len(starts) > 1:
        second = np.ones(len(starts), bool)
        second[rows[:-1][rows[:-1] < len(starts)]] = False
        at = np.flatnonzero(second)
        both = crc_states(data, starts[at], ends[at], _step(word[at - 1], np.uint32(32)))
        pair[at] = ~both % np.uint32(buckets)
    return (~word % np.uint32(buckets)).astype(np.int64), pair, rows


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in textkit.blocks(batch.column("text")):
                word, pair, _ = features(data, offsets, buckets)
                sums += np.bincount(word, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all features of a table's texts."""
    return rows.select("text").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: an array of `buckets` numbers."""
    spark = docs.sparkSession
    both = bucket_counts(docs, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full_outer")
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    sums = Window.partitionBy(F.lit(0))  # over `buckets` rows
    real = every.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))
    summed = real.withColumns({"all_s": F.sum("s").over(sums), "all_t": F.sum("t").over(sums)})
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = summed.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # `buckets` rows
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def _weighed(table: list[int], kept: list[str]):
    gain = np.array([*table, 0], np.int64)  # the last one is for "no pair"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in textkit.blocks(batch.column("text")):
                word, pair, rows = features(data, offsets, len(gain) - 1)
                sums = np.concatenate([[0], np.cumsum(gain[word] + gain[pair])])
                n = np.diff(rows)
                parts.append((n, sums[rows[1:]] - sums[rows[:-1]]))
            n, total = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
            n_features = np.maximum(2 * n - 1, 0)
            weight = total // np.maximum(n_features, 1)
            own = [pa.array(n.astype(np.int64)), pa.array(n_features.astype(np.int64)), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own], [*kept, "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, table: list[int], kept: list[str]) -> DataFrame:
    """The columns `kept` of docs (which has text) plus n_words, n_features, weight."""
    read = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", n_words long, n_features long, weight long"
    return read.mapInArrow(_weighed(table, kept), schema)


def score(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """weight plus Gumbel noise of the id, in thousandths, rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digits(bits: int, width: int) -> list[tuple[int, int]]:
    """(shift, bits) of the digits of a number of that many bits, least significant first, of nearly equal sizes."""
    passes = -(-bits // width)
    ends = [bits * k // passes for k in range(passes + 1)] if passes else [0]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def counting_sort(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """One stable pass: rows with their position among all rows ordered by (digit, position)."""
    dealt = rows.withColumns({"digit": digit.cast("int"), "block": F.floor(F.col("position") / block)})
    counts = dealt.groupBy("digit", "block").agg(F.count("*").alias("n_"))
    totals = counts.groupBy("digit").agg(F.sum("n_").alias("all_"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("digit", earlier("all_", Window.partitionBy(F.lit(0)).orderBy("digit")).alias("base"))  # 2**DIGIT_BITS rows at most
    begins = counts.select("digit", "block", earlier("n_", Window.partitionBy("digit").orderBy("block")).alias("before")).join(F.broadcast(base), "digit")
    within = F.row_number().over(Window.partitionBy("digit", "block").orderBy("position")) - 1
    moved = dealt.withColumn("within", within).join(begins, ["digit", "block"])
    return moved.withColumn("position", F.col("base") + F.col("before") + F.col("within")).select(*rows.columns)


def radix_ranked(rows: DataFrame, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """rows (doc_id, score, ...) with rank from 1: higher scores first, then smaller doc_id, null last."""
    placed = numbered(rows.withColumn("__all", F.lit("")), "__all").drop("__all", "n")
    kept = durable(placed.withColumn("id_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))))
    release(placed)
    ends = kept.agg(F.count("*").alias("n"), F.min("id_key").alias("a"), F.max("id_key").alias("b"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    if not ends["n"]:
        return kept.drop("id_key", "position").withColumn("rank", F.lit(0).cast("long"))
    block = max(LEAST_BLOCK, 1 << math.isqrt(ends["n"]).bit_length())
    # Bits above the highest one in which the smallest and the largest id differ are the same in all ids; the sign turns the order.
    id_bits = ((ends["a"] ^ ends["b"]) & (2**64 - 1)).bit_length()
    number = F.col("id_key").bitwiseXOR(F.lit(-(2**63)))
    rank_key = (F.lit(ends["high"]) - F.col("score")) * 2 + F.col("doc_id").isNull().cast("long")
    passes = [(number, *d) for d in _digits(id_bits, digit_bits)] + [(rank_key, *d) for d in _digits((2 * (ends["high"] - ends["low"]) + 1).bit_length(), digit_bits)]
    for value, shift, bits in passes:
        older, kept = kept, durable(counting_sort(kept, F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1)), block))
        release(older)
    return kept.withColumn("rank", F.col("position") + 1).drop("id_key", "position")


def _ranked(docs: DataFrame, target: DataFrame, kept: list[str], percent: int, min_words: int, seed: int, buckets: int) -> DataFrame:
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column; give other ids a number first")
    scored = durable(weigh(docs, gains(docs, target, buckets), kept).withColumn("score", score(seed=seed)))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = radix_ranked(able)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), all long: one row per row of docs."""
    ranked = _ranked(docs.select("doc_id", "text"), target, ["doc_id"], percent, min_words, seed, buckets)
    return ranked.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score", "rank")))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that are drawn, with all their columns and weight, score, rank."""
    inner = durable(aside(docs, "doc_id", "text").withColumn("__row", F.monotonically_increasing_id()))
    ranked = _ranked(inner, target, ["doc_id", "__row"], percent, min_words, seed, buckets).where(F.col("rank").isNotNull())
    return back(inner.join(ranked.select("__row", "weight", "score", "rank"), "__row"), docs, ("doc_id", "text"), ("weight", "score", "rank"))

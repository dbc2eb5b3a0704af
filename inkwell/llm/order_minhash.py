"""Operator 8: near duplicates by Order MinHash and banded alignment.

A text is the sequence of its SHINGLE-word shingles (both ends are padded with
marks), each labelled with its occurrence number (so all are different).  A sketch takes, under one hash
function, the PICK smallest labelled shingles and keeps them in text order;
equal sketches need the same shingles in the same order, so they follow edit
similarity, not only overlap.  SKETCHES sketches are taken of every text, and
texts that share one are candidates.

A candidate is verified by aligning the two word sequences within the band
that the threshold leaves: with L words aligned in order, the similarity is
L / (|A| + |B| - L), and it must reach the threshold.  So one changed word
costs one symbol, not all the shingles it lies in.

Classes are the connected components of verified links and of equal texts.
No bucket is expanded into all its pairs:

1. equal texts (equal word sequences) become one node;
2. in each bucket every text is compared with the smallest id only, and
   components are formed; in buckets that hold several components, the texts
   outside the largest one are compared with one text of it, picked by a hash
   that differs from bucket to bucket, and components are formed again;
3. texts that are then still outside their bucket's largest component are
   compared with that component's texts, and with all others outside it,
   through an exact prefix filter: two texts that reach the threshold share so
   many labelled words that they share one among the rarest of each, wherever
   "rare" is measured.  Words of a passage that is in many texts are frequent
   there and join nobody; a copy with too many edits has its own edits as its
   rarest words.  So the pairs follow real likeness, not the square of a
   bucket.  Texts outside meet by their component, not by each bucket they
   share, and rare words that only one component has are left out before.

Before texts are fetched for a pair it must pass two bounds on data that each
node carries: the numbers of words, and 64 one-bit minima over labelled words.
Texts at the threshold differ in 6 of these bits on average; a pair that
differs in more than BITS is left out (for a pair at the threshold the chance
of that is below one in a hundred thousand).

Defined results: texts without words, and rows without doc_id, get no class
(null); rows that share a doc_id are one document; ids that are no integers
raise an error; extra columns are ignored; ties go to the smaller id; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkwell.llm import textkit
from inkwell.llm.components import components
from inkwell.llm.durable import durable, release
from inkwell.llm.workers import tidy

SHINGLE, PICK, SKETCHES = 5, 2, 64
THRESHOLD = 0.8
BITS = 18
COMPONENT_WEIGHT = 100
#: Texts of which one is looked at for sketches that many share, how many texts are many, and how many such sketches there are at most.
HOT_SAMPLE, HOT_TEXTS, HOT_BUCKETS = 16, 4096, 4096
_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(6).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(symbols: np.ndarray) -> np.ndarray:
    """Symbols told apart by their occurrence numbers, in text order."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.zeros(len(symbols), np.uint64)
    if not new.all():
        at = np.arange(len(symbols))
        number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return textkit.mix(symbols + number * np.uint64(0x9E3779B97F4A7C15))


def labelled_shingles(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the labelled shingles in text order; both ends are padded, so that a word lies in as many shingles anywhere."""
    if not len(words):
        return words
    start, end = (np.full(shingle - 1, mark, np.uint64) for mark in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))
    return labelled(textkit.chained(np.concatenate([start, words, end]), shingle))


def sketches(shingles: np.ndarray, count: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """The hashes of `count` order sketches."""
    n = len(shingles)
    take = min(pick, n)  # padded texts have more shingles than that
    out = np.empty(count, np.uint64)
    step = max(1, (1 << 18) // n)
    for at in range(0, count, step):
        some = _MULTIPLIERS[at : min(at + step, count), None]
        values = shingles[None, :] * some
        values ^= values >> np.uint64(32)
        values *= some
        rows = np.arange(len(some))
        chosen = np.empty((len(some), take), np.int64)
        for k in range(take):
            chosen[:, k] = values.argmin(axis=1)
            values[rows, chosen[:, k]] = np.uint64(2**64 - 1)
        kept = shingles[np.sort(chosen, axis=1)]
        out[at : at + len(some)] = (textkit.mix(kept * _PLACES[:take])).sum(axis=1, dtype=np.uint64)
    return textkit.mix(out + np.arange(count, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bits(words: np.ndarray) -> int:
    """64 bits: one of the smallest labelled word in each of 64 bins (0 in an empty bin)."""
    values = textkit.mix(words ^ np.uint64(0x8EBC6AF09C88C6E3))
    least = np.full(64, 2**64 - 1, np.uint64)
    np.minimum.at(least, (values >> np.uint64(58)).astype(np.int64), values)
    odd = textkit.mix(least) & np.uint64(1)
    odd[least == np.uint64(2**64 - 1)] = 0
    return int(np.packbits(odd.astype(np.uint8)).view(">u8")[0])


#: Up to this length a row of an alignment is one number; beyond, up to so many matches a symbol single matches are followed.
SHORT, FEW_MATCHES = 8192, 24
_ROWS = 2048


def _common(a: list, b: list, band: int) -> int:
    """The longest common subsequence of matches (i, j) with |i - j| <= band.

    After i symbols of a the state is the increasing list of the smallest
    places of b at which common subsequences of 1, 2, 3... end; a match at j
    takes the place of the next larger one.  The places are the zeros of one
    number of len(b) bits, and a row of matches is one addition.  For long
    texts the work follows the matches or the band, not len(a) * len(b): where
    matches are few, the list is kept as such and searched by bisection; else
    only the bits near the band are kept in hand.
    """
    if len(b) > SHORT:
        return _common_of_long(a, b, band)
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row, reach = every, (1 << 2 * band + 1) - 1
    for i, x in enumerate(a):
        met = places.get(x)
        if met:
            met &= reach << i - band if i >= band else reach >> band - i
            met &= row
            row = (row + met | row - met) & every
    return len(b) - row.bit_count()


def _common_of_long(a: list, b: list, band: int) -> int:
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    if sum(len(places.get(x, ())) for x in a) > FEW_MATCHES * len(a):
        return _common_in_rows(a, len(b), places, band)
    ends: list = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):  # larger places first, so that a row uses each symbol of a once
            if -band <= i - j <= band:
                at = bisect_left(ends, j)
                if at == len(ends):
                    ends.append(j)
                else:
                    ends[at] = j
    return len(ends)


def _common_in_rows(a: list, size: int, places: dict, band: int) -> int:
    """The same with only the bits within the band of the next _ROWS symbols in hand; those below are final."""
    done, low, top = 0, 0, 0  # bits low to top - 1 are in hand
    row = 0
    for start in range(0, len(a), _ROWS):
        if (fresh := min(size, max(0, start - band))) > low:
            final = row & ((1 << fresh - low) - 1)
            done += fresh - low - final.bit_count()
            row, low = row >> fresh - low, fresh
        if (reach := min(size, start + _ROWS + band)) > top:
            row |= ((1 << reach - top) - 1) << top - low
            top = reach
        every = (1 << top - low) - 1
        masks: dict = {}  # of the symbols of these rows, over the bits in hand
        for i in range(start, min(start + _ROWS, len(a))):
            x = a[i]
            if x not in places:
                continue
            met = masks.get(x)
            if met is None:
                bits_of = np.zeros(top - low + 8, np.uint8)
                at = places[x]
                bits_of[np.array(at[bisect_left(at, low) : bisect_left(at, top)], np.int64) - low] = 1
                met = masks[x] = int.from_bytes(np.packbits(bits_of, bitorder="little").tobytes(), "little")
            first = max(0, i - band - low)
            met = (met >> first & (1 << i + band + 1 - low - first) - 1) << first & row
            if met:
                row = (row + met | row - met) & every
    return done + top - low - row.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """The longest common subsequence of two sequences within the band; 0 if it cannot reach the threshold."""
    total = len(a) + len(b)
    least = threshold * total / (1 + threshold) - 1e-9
    short = min(len(a), len(b))
    if short < least:
        return 0
    differs = a[:short] != b[:short]
    head = int(differs.argmax()) if differs.any() else short
    differs = a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1]
    tail = int(differs.argmax()) if differs.any() else short - head
    # Equal ends are always part of a longest alignment; what lies between is aligned within the band.
    length = head + tail + _common(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), int(total - 2 * least))
    return length if length >= least else 0


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """L / (|A| + |B| - L) of the banded alignment; 0 where the threshold is out of reach."""
    length = alignment(a, b, threshold)
    return length / (len(a) + len(b) - length) if length else 0.0


def _words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return textkit.word_hashes(raw, *textkit.word_spans(raw, np.array([0, len(raw)]))[:2])


_NODE = "id long, c1 long, c2 long, n int, bits long, sigs array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id")).astype(np.int64)
        keep, whole, n, marks, sigs = [], [], [], [], []
        for first, _, data, offsets in textkit.blocks(batch.column("text")):
            starts, ends, at = textkit.word_spans(data, offsets)
            words, raw = textkit.word_hashes(data, starts, ends), data.tobytes()
            for row in np.flatnonzero(at[1:] > at[:-1]):
                own = words[at[row] : at[row + 1]]
                keep.append(first + row)
                whole.append(hashlib.md5(b" ".join(raw[offsets[row] : offsets[row + 1]].split()), usedforsecurity=False).digest())
                n.append(len(own))
                marks.append(bits(labelled(own)))
                sigs.append(sketches(labelled_shingles(own)))
        both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
        flat = np.concatenate(sigs).view(np.int64) if sigs else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * SKETCHES), pa.array(flat))
        columns = [ids[np.array(keep, np.int64)], both[:, 0].copy(), both[:, 1].copy(), np.array(n, np.int32), np.array(marks, np.uint64).view(np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["id", "c1", "c2", "n", "bits", "sigs"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # neighbouring pairs often share a text
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b").to_pylist(), strict=True):
                if a != last:
                    last, held = a, _words(ta.as_py().encode())
                ok.append(similarity(held, _words(tb.encode()), threshold) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = [labelled(_words(t.encode())) for t in batch.column("text").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(some)), [len(x) for x in some]))
        flat = np.concatenate(some) if some else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(flat.view(np.int64))], ["id", "label", "w"])


def _prefixes(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """id, n, bits, label, w, rank: of each node the rarest labelled words (counted over these nodes), one of which every partner has too."""
    some = nodes.select("id", "n", "bits", "label").distinct()
    words = durable(texts.join(some.select("id", "label"), texts["doc_id"] == F.col("id")).select("id", "label", "text").mapInArrow(tidy(_word_rows), "id long, label long, w long"))
    # Any order of the words is exact.  In this one, words that make up a component come last, so that what sets a text apart from it is rare.
    counts = words.groupBy("w", "label").agg(F.count("*").alias("n"))
    known = counts.groupBy("w").agg((F.sum("n") + COMPONENT_WEIGHT * F.max("n")).alias("df"), F.sum("n").alias("times")).where("times > 1").drop("times")
    listed = words.drop("label").join(known, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws")).join(some, "id")
    # A partner has at least threshold * n of the n words.  Words that nobody else has come first, and join nobody.
    alone = F.col("n") - F.size("ws")
    spare = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - alone
    cut = F.slice("ws", F.lit(1), F.greatest(spare, F.lit(0)).cast("int"))
    return listed.select("id", "n", "bits", "label", alone.alias("alone"), F.posexplode(cut).alias("at", "s")).select("id", "n", "bits", "label", F.col("s.w").alias("w"), (F.col("at") + F.col("alone") + 1).alias("rank"))


def _met(prefix: DataFrame) -> DataFrame:
    """The rows of _prefixes whose word is in the prefixes of two components; the others join nobody."""
    met = prefix.groupBy("w").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("w")
    return prefix.join(met, "w", "left_semi").select(*prefix.columns)


def _apart(prefix: DataFrame, outside: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs from different components that share a prefix word: the texts of outside (id, main) that have one main, and these with the texts of main."""
    apart = (F.col("labelx") != F.col("labely")) & _able("x", "y", threshold) & _in_prefixes("x", "y", threshold)
    outer = durable(prefix.join(outside.distinct(), "id"))
    mains = prefix.join(outside.select(F.col("main").alias("label")).distinct(), "label", "left_semi")
    within = _side(outer, "x").join(_side(outer, "y"), (F.col("mainx") == F.col("mainy")) & (F.col("wx") == F.col("wy")) & (F.col("idx") < F.col("idy")) & apart)
    across = _side(outer, "x").join(_side(mains, "y"), (F.col("mainx") == F.col("labely")) & (F.col("wx") == F.col("wy")) & apart)
    return _pairs(within).unionByName(_pairs(across)).distinct()


def _able(x: str, y: str, threshold: float):
    """Bounds that two nodes have to meet before their texts are compared."""
    n = lambda s: F.col(f"n{s}").cast("double")
    sizes = F.least(n(x), n(y)) >= threshold * F.greatest(n(x), n(y)) - 1e-6
    return sizes & (F.bit_count(F.col(f"bits{x}").bitwiseXOR(F.col(f"bits{y}"))) <= BITS)


def _in_prefixes(x: str, y: str, threshold: float):
    """The shared word is early enough in both orders for two nodes of these sizes."""
    least = F.ceil((F.col(f"n{x}") + F.col(f"n{y}")) * (threshold / (1 + threshold)) - 1e-9)
    return (F.col(f"rank{x}") <= F.col(f"n{x}") - least + 1) & (F.col(f"rank{y}") <= F.col(f"n{y}") - least + 1)


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}{x}") for c in rows.columns))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return durable(both.mapInArrow(tidy(_verify(threshold)), "a long, b long"))


def _outside(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """b, id, n, bits, label, main, pick: the texts outside the largest component of their bucket (main) and one text of it, another one in each bucket."""
    member = buckets.join(label, buckets["id"] == label["u"], "left").select("b", "id", "n", "bits", F.coalesce("v", "id").alias("label"))
    pick = F.min_by(F.struct("id", "n", "bits"), F.xxhash64(F.lit(1), "b", "id"))
    parts = member.groupBy("b", "label").agg(F.count("*").alias("size"), pick.alias("pick"))
    largest = F.max_by(F.struct(F.col("label").alias("main"), "pick"), F.struct("size", "label"))
    mains = parts.groupBy("b").agg(largest.alias("m"), F.count("*").alias("parts")).where("parts > 1").select(F.col("b").alias("bm"), "m.*")
    return member.join(mains, (F.col("b") == F.col("bm")) & (F.col("label") != F.col("main"))).drop("bm")


def _beside(rows: DataFrame, other: str, threshold: float) -> DataFrame:
    """The rows whose text may reach the threshold with the one in the struct column `other`."""
    flat = rows.select(*(F.col(c).alias(f"{c}x") for c in ("id", "n", "bits")), *(F.col(f"{other}.{c}").alias(f"{c}y") for c in ("id", "n", "bits")))
    return flat.where((F.col("idx") != F.col("idy")) & _able("x", "y", threshold))


def _relabelled(few: DataFrame, label: DataFrame) -> DataFrame:
    """b, id, label, main by the components of now; rows whose text has joined the main one go."""
    own, mains = (label.select(F.col("u").alias(u), F.col("v").alias(v)) for u, v in (("u1", "v1"), ("u2", "v2")))
    now = few.join(own, F.col("id") == F.col("u1"), "left").join(mains, F.col("main") == F.col("u2"), "left")
    return now.select("b", "id", F.coalesce("v1", "id").alias("label"), F.coalesce("v2", "main").alias("main")).where("label <> main")


def _more(label: DataFrame, links: DataFrame) -> DataFrame:
    return components(label.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links)) if links.limit(1).count() else label


def _hot_buckets(kept: DataFrame, sample: int = HOT_SAMPLE, many: int = HOT_TEXTS, most: int = HOT_BUCKETS) -> list[int]:
    """Sketches that many texts share, at most `most` of them, by the count in a sample of the texts.  It decides how rows travel, never what is found."""
    rows = kept.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(sample)) == 0).select(F.explode("sigs").alias("b"))
    counts = durable(rows.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"))
    least = max(many // sample, -(-(counts.agg(F.sum("n")).first()[0] or 0) // most))
    found = [r["b"] for r in counts.where(F.col("n") > least).collect()]
    release(counts)
    return found


def _bucketed(kept: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """b, id, n, bits, c: the rows of buckets with several texts, and the text of the smallest id of each as its centre.

    One shuffle brings the rows of a bucket together.  Buckets that many texts
    share do not take part: their centres are found by an aggregation that
    combines in each task, and a list of at most HOT_BUCKETS centres goes to
    the rows, which stay where they are.
    """
    hot = _hot_buckets(kept) if hot is None else hot
    rows = kept.select("id", "n", "bits", F.explode("sigs").alias("b"))
    node = F.struct("id", "n", "bits")
    centred = lambda some: some.groupBy("b").agg(F.min(node).alias("c"), F.max(node).alias("z")).where("c.id < z.id").select("b", "c")
    cold = (rows.where(~F.col("b").isin(hot)) if hot else rows).repartition("b")
    found = cold.join(centred(cold), "b")
    if hot:
        many = rows.where(F.col("b").isin(hot))
        found = found.unionByName(many.join(F.broadcast(centred(many)), "b"))
    return found.select("b", "id", "n", "bits", "c")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class): one row per row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column; give other ids a number first")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketched = durable(texts.mapInArrow(tidy(_sketch), _NODE))
    # Equal texts: the smallest id stands for them.
    copies = durable(sketched.groupBy("c1", "c2").agg(F.min("id").alias("rep")))
    kept = sketched.join(copies, ["c1", "c2"]).where(F.col("id") == F.col("rep"))
    nodes = kept.select("id", "n", "bits").distinct()
    buckets = durable(_bucketed(kept))

    tried = durable(_pairs(_beside(buckets, "c", threshold)))
    label = components(_links(tried, texts, threshold))
    few = durable(_outside(buckets, label))

    new = durable(_pairs(_beside(few, "pick", threshold)).join(tried, ["a", "b"], "left_anti"))
    tried = tried.unionByName(new)
    label = _more(label, _links(new, texts, threshold))
    few = durable(_relabelled(few.select("b", "id", "main"), label))

    # What is left, exactly: with the texts outside of the same main component, and with the texts of that component.
    named = nodes.join(label, nodes["id"] == label["u"], "left").select("id", "n", "bits", F.coalesce("v", "id").alias("label"))
    asked = few.select(F.col("main").alias("label")).unionByName(few.select("label")).distinct()
    every = durable(_prefixes(named.join(asked, "label", "left_semi"), texts, threshold))
    prefix = durable(_met(every))
    release(every)
    new = durable(_apart(prefix, few.select("id", "main"), threshold).join(tried, ["a", "b"], "left_anti"))
    label = _more(label, _links(new, texts, threshold))

    # A document's class is the class of its text; several texts of one id are one document.
    own = sketched.select("id", "c1", "c2").join(copies, ["c1", "c2"])
    classed = own.join(label, own["rep"] == label["u"], "left").groupBy("id").agg(F.min(F.coalesce("v", "rep")).alias("class_id"))
    return docs.select("doc_id").join(classed.withColumnRenamed("id", "doc_id"), "doc_id", "left")

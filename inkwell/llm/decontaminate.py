"""Operator 5: benchmark decontamination with one Aho-Corasick automaton.

Texts and test items are normalised alike: A-Z in lower case, words are runs
of ASCII digits, ASCII letters and all characters beyond ASCII.  A window is
WINDOW consecutive words of an item (a shorter item is one window).

Spelling every window out would make an automaton of several hundred times the
items' bytes.  It holds short pieces instead: PIECE words at every
(WINDOW - PIECE + 1)-th word of an item, of which every window has one whole.
A text, written as words with one space around each, is scanned once; a text
without any piece is done.  Where a piece is found, the windows of the text
around it are looked up in a sorted array of the hashes of all windows, and
what is found there is compared with the item, byte by byte, so hits are
exact.  Items shorter than a window are pieces of their own.  Hits come as
character offsets, which are mapped back to word numbers and to offsets in the
original text.

The items are broadcast and every worker builds the automaton, so their size
is checked first: a table of at most `block_bytes` of item text is one
automaton (of about 40 times that); a larger one is dealt into as many blocks
as that needs, the texts are scanned once for each block, and the blocks' hits
are united per document.

Defined results: a null text or item has no words; an item without words never
hits; equal items each count; a null item_id counts as an item of no name and
is left out of items; rows that repeat a document are each judged by
themselves; an empty table of items hits nothing; other columns pass through
whatever their names, except that the result's own n_words, hit_words, items
and hit_offsets replace columns of those names in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.columns import aside, back
from inkwell.llm.workers import tidy

WINDOW = 10
PIECE = 4
BLOCK_BYTES = 8 << 20
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_LOWER = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def _tokens(text: str | None) -> list[bytes]:
    """The words of a text; all ASCII but digits and letters separates, nothing beyond ASCII does."""
    return (text or "").encode().translate(_LOWER).split()


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    tokens = [t.decode() for t in _tokens(text)]
    if not tokens:
        return set()
    return {" " + " ".join(tokens[i : i + size]) + " " for i in range(max(1, len(tokens) - size + 1))}


def _line(tokens: list[bytes]) -> bytes:
    return b" " + b" ".join(tokens) + b" "


def _word_places(tokens: list[bytes]) -> np.ndarray:
    """Where in a line each word's leading space is, and the last space."""
    return np.cumsum([0] + [len(t) + 1 for t in tokens])


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


class Matcher:
    """The automaton over pieces of some items, and their windows as sorted hashes."""

    def __init__(self, items: list[tuple[object, str]], size: int = WINDOW):
        self.names, self.size, self.piece = [name for name, _ in items], size, min(PIECE, size)
        self.lines: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        hashes, item, place, end = [], [], [], []
        short: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(items):
            tokens = _tokens(text)
            self.lines.append(_line(tokens))
            if not tokens:
                continue
            if len(tokens) < size:
                short.setdefault(self.lines[-1].decode(), []).append(i)
                continue
            at = _word_places(tokens)
            for k in range(0, len(tokens) - self.piece + 1, size - self.piece + 1):
                self.automaton.add_word(self.lines[-1][at[k] : at[k + self.piece] + 1].decode(), None)
            starts = np.arange(len(tokens) - size + 1)
            hashes += [_hash(self.lines[-1][at[k] : at[k + size] + 1]) for k in starts]
            item.append(np.full(len(starts), i))
            place.append(at[starts])
            end.append(at[starts + size] + 1)
        for line, who in short.items():
            self.automaton.add_word(line, (who, self.automaton.exists(line)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        hashed = np.array(hashes, np.uint64)
        order = np.argsort(hashed, kind="stable")
        joined = lambda parts: (np.concatenate(parts) if parts else np.empty(0)).astype(np.int32)[order]
        self.hashes, self.item, self.place, self.end = hashed[order], joined(item), joined(place), joined(end)

    def _owners(self, window: bytes) -> set[int]:
        """The items that have this window."""
        key = np.uint64(_hash(window))
        some = range(np.searchsorted(self.hashes, key), np.searchsorted(self.hashes, key, side="right"))
        return {int(self.item[k]) for k in some if self.lines[self.item[k]][self.place[k] : self.end[k]] == window}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, hit stretches of words [start, end), numbers of the items that hit)."""
        tokens = _tokens(text)
        if self.empty or not tokens:
            return len(tokens), [], set()
        line = _line(tokens)
        found = list(self.automaton.iter(line.decode()))
        if not found:
            return len(tokens), [], set()
        at, chars = _word_places(tokens), np.cumsum([0] + [len(t.decode()) + 1 for t in tokens])
        last = np.searchsorted(chars, [x for x, _ in found])  # the word that follows the match
        spans, who, asked = [], set(), set()
        for (_, value), end in zip(found, last.tolist(), strict=True):
            owners, is_piece = (value[0], value[1]) if value else ((), True)
            for i in owners:
                spans.append((end - len(self.lines[i].split()), end))
                who.add(i)
            if is_piece:
                begin = end - self.piece
                asked.update(range(max(0, begin - self.size + self.piece), min(begin, len(tokens) - self.size) + 1))
        for k in asked:
            if owners := self._owners(line[at[k] : at[k + self.size] + 1]):
                spans.append((k, k + self.size))
                who |= owners
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return len(tokens), out, who


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word stretches as code point offsets [start, end) in the original text."""
    data = np.frombuffer(text.encode(), np.uint8)
    word = np.isin(data, np.frombuffer(_SEPARATORS, np.uint8), invert=True)
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in spans]


def _scanner(shared, size: int, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, size)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, spans, items, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                count, hit, who = matcher.scan(text)
                n.append(count)
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted({str(matcher.names[i]) for i in who if matcher.names[i] is not None}))
                places.append([{"start": a, "end": b} for a, b in original_offsets(text, hit)] if with_offsets and hit else [])
            own = [pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string())), pa.array(places, spans_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "n_words", "hit_words", "items", "hit_offsets"])

    return tidy(run)


_SPANS = "array<struct<start:long,end:long>>"
OWN = ("n_words", "hit_words", "items", "hit_offsets")


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs plus n_words, hit_words (stretches of words), items (names, sorted as strings) and hit_offsets."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    given, docs = docs, aside(docs, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", n_words long, hit_words {_SPANS}, items array<string>, hit_offsets {_SPANS}"
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    passes = []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).collect()  # block_bytes of text at most, up to the luck of the deal
        passes.append(docs.mapInArrow(_scanner(spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows]), size, True), schema))
    found = passes[0] if blocks == 1 else _unite(docs, passes)
    return back(found, given, ("text",), OWN)


def _unite(docs: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """The hits of several passes per document; rows are told apart by all their values."""
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    keys = [F.col(f"`{c}`") for c in docs.columns]
    merged = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    united = every.groupBy(*keys).agg(F.first("n_words").alias("n_words"), merged("hit_words"), merged("items"), merged("hit_offsets"), (F.count("*") / len(passes)).cast("int").alias("copies"))
    fold = lambda name: F.aggregate(
        name,
        F.array().cast(_SPANS),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    united = united.withColumn("hit_words", fold("hit_words")).withColumn("hit_offsets", fold("hit_offsets"))
    return united.withColumn("copies", F.explode(F.array_repeat("copies", F.col("copies")))).drop("copies")

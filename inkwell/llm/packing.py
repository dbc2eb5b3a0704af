"""Operator 7: packing token sequences by linear grouping and best fit.

A document becomes token ids plus an end id; only one longer than the capacity
is cut, into pieces of the capacity (the last may be shorter).  Packing needs
nothing but lengths, and there are at most `capacity` of them, so the plan is
made from their histogram, whose size does not depend on the corpus:

1. Large pieces (over capacity / 8) in order of length are dealt into groups
   of equal cardinality, and each group's lengths are rounded up to its
   largest (the linear grouping scheme).
2. Configurations over those few sizes are chosen one after another: the
   largest size left, completed to the fullest sum that the numbers left
   allow; it is used as often as they last.
3. The actual lengths take the places of the rounded ones, which leaves
   sequences with a little more room than planned.
4. Small pieces, longest first, go where they fit best; new sequences are
   opened when none has room.

Sequences alike are handled as ranges of numbers, never one by one.  The plan
is a list of segments: the pieces of one length with ranks r, r+1, ... go to
sequences s, s+1, ... at one offset.  Executors rank the pieces of a length
(dealt over buckets, so that a frequent length is no hot task) and look their
segment up.

Defined results: a null text is packed as an empty one (just the end id);
rows that repeat a document are packed each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import textkit
from inkwell.llm.durable import durable
from inkwell.llm.workers import tidy

CAPACITY = 4096
END_ID = 1
GROUPS = 200
CACHE_WORDS = 350_000  # of each of two generations
CACHE_PARTS = 500_000
CHUNK_BYTES = 2 << 20  # the words of one chunk are in hand as strings, ten times its size
#: Lower-case Latin letters up to U+017F, and all characters whose normal form, class and lower case are those of the
#: tokenizer letter by letter.  A word with any other character is left to the tokenizer itself.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = "\t\n\r\x20-\x7e\u00a1\u00ab\u00bb\u00bf\u00c0-\u012f\u0131-\u017f\u2010-\u2027"
_odd = re.compile(f"[^{_PLAIN}]").search
#: Fixed value: how the tokenizer splits lower-case text before its merges; a line end is a part of its own here.
_parts = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r0-9{_LETTERS}]+").findall
_words = re.compile("[^ \t\n\r]+").findall
#: Never inside a list of ids, whose upper bytes are zero.
_BREAK = b"\xff\xff\xff\xff"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of white-space separated words, kept in a bounded cache.

    The tokenizer drops white space and never merges across it, so a text's
    ids are its words' ids one after another.  It also lowers a word and splits
    it into parts before its merges, so words share their parts' ids whatever
    their case and the marks after them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": _BREAK}
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelled(chr(c))[0][0] for c in range(0x80, 0x2028) if not _odd(chr(c))}
        self.merge = self.tokenizer.model.tokenize

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: set[str]) -> None:
        """Lowering and splitting are done, so the merges alone are left; they want bytes spelled as letters."""
        for part in parts:
            tokens = self.merge(part if part.isascii() else part.translate(self.spelling))
            self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    @staticmethod
    def _split(text: str) -> list[str]:
        """The words of a text, in lower case unless only the tokenizer itself knows how to lower and split one."""
        if not _odd(text) and "<|" not in text:
            return text.lower().split()
        return [w if _odd(w) or "<|" in w else w.lower() for w in _words(text)]

    def learn(self, missing: set[str]) -> None:
        if len(self.parts) > CACHE_PARTS:
            self.parts = {"\n": _BREAK}
        seen = missing.intersection(self.old)
        self.words.update((w, self.old[w]) for w in seen)
        words = missing.difference(seen)
        odd = [w for w in words if (not w.isascii() and _odd(w)) or "<|" in w or (w.isascii() and not w.isprintable())]
        if odd:
            self.words.update(zip(odd, self._encode(odd), strict=True))
            words.difference_update(odd)
        if words:
            plain = list(words)
            parts = _parts("\n".join(plain))
            self._encode_parts(set(parts).difference(self.parts))
            found = b"".join(map(self.parts.__getitem__, parts)).split(_BREAK)
            self.words.update(zip(plain, found, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; texts of a few megabytes together."""
        words = list(map(self._split, texts))
        every = set().union(*words)
        missing = every.difference(self.words)
        if len(self.words) + len(missing) > CACHE_WORDS:  # the last generation stays at hand until the next one is full
            self.old, self.words, missing = self.words, {}, every
        if missing:
            self.learn(missing)
        word = self.words.__getitem__
        return [b"".join(map(word, some)) for some in words]


def _tokenise(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds(path), END_ID.to_bytes(4, "little")  # its words go with the task
        gc.disable()  # short-lived lists of words only; without cycles there is nothing to search for
        for batch in batches:
            rows, piece, length, crc = [], [], [], []
            texts = batch.column("text")
            for first, last, _, _ in textkit.blocks(texts, CHUNK_BYTES):
                for i, ids in enumerate(coder.ids([t or "" for t in texts.slice(first, last - first).to_pylist()]), first):
                    buf = ids + end
                    for k, at in enumerate(range(0, len(buf), 4 * capacity)):
                        part = buf[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            take = batch.column("doc_id").take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([take, pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "length", "ids_crc32"])
        gc.enable()

    return tidy(run)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(_tokenise(tokenizer or default_tokenizer(), capacity), f"doc_id {kind}, piece int, length long, ids_crc32 long")
    return rows.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32")


class Plan:
    """Segments (length, first rank, number, first sequence, offset) from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity = capacity
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._rank = dict.fromkeys(histogram, 0)
        self._room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, number)
        self._rooms: list[int] = []
        large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if 8 * n > capacity]
        self._place_large(self._grouped(large, groups))
        for n, c in sorted(histogram.items(), reverse=True):
            if 8 * n <= capacity:
                self._best_fit(n, c)

    def _leave(self, room: int, first: int, number: int) -> None:
        if room and number:
            if not self._room.get(room):
                insort(self._rooms, room)
                self._room[room] = []
            self._room[room].append((first, number))

    def _put(self, length: int, number: int, first: int, offset: int) -> None:
        self.segments.append((length, self._rank[length], number, first, offset))
        self._rank[length] += number

    @staticmethod
    def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
        """Groups of [length, number] parts, longest first, of nearly equal cardinality."""
        total = sum(c for _, c in large)
        size, out, left = max(1, -(-total // groups)), [], 0
        for n, c in large:
            while c:
                if not left:
                    out.append([])
                    left = size
                out[-1].append([n, take := min(c, left)])
                c, left = c - take, left - take
        return out

    def _place_large(self, groups: list[list[list[int]]]) -> None:
        sizes = [g[0][0] for g in groups]
        counts = [sum(c for _, c in g) for g in groups]
        top = 0
        while top < len(sizes):
            if not counts[top]:
                top += 1
                continue
            config = self._fullest(sizes, counts, top)
            times = min(counts[k] // m for k, m in config.items())
            ranges = [[self.sequences, times, 0]]  # first sequence, number, used
            self.sequences += times
            for k, m in sorted(config.items()):
                counts[k] -= m * times
                for _ in range(m):
                    ranges = self._substitute(groups[k], ranges)
            for first, number, used in ranges:
                self._leave(self.capacity - used, first, number)

    def _fullest(self, sizes: list[int], counts: list[int], top: int) -> dict[int, int]:
        """{group: times} with the largest sum that fits and holds group `top`."""
        room = self.capacity - sizes[top]
        by = np.full(room + 1, -2, np.int64)  # the group whose size was added last to reach a sum; -1: nothing added
        by[0] = -1
        for k in range(top, len(sizes)):
            have, size = counts[k] - (k == top), sizes[k]
            for _ in range(min(have, room // size)):
                new = np.flatnonzero((by[size:] == -2) & (by[: room + 1 - size] != -2)) + size
                if not len(new):
                    break
                # Sums reached in this very pass must not be extended again within it: one more copy a pass.
                by[new] = k
            if by[room] != -2:
                break
        config, at = {top: 1}, int(np.flatnonzero(by != -2)[-1])
        while at:
            k = int(by[at])
            config[k] = config.get(k, 0) + 1
            at -= sizes[k]
        for k, m in list(config.items()):  # a path through the table can use a size more often than is left
            if m > counts[k]:
                config[k] = counts[k]
        return config

    def _substitute(self, parts: list[list[int]], ranges: list[list[int]]) -> list[list[int]]:
        """Puts one actual piece of a group into each sequence of the ranges."""
        out = []
        for first, number, used in ranges:
            while number:
                length, have = parts[0]
                take = min(number, have)
                self._put(length, take, first, used)
                out.append([first, take, used + length])
                first, number = first + take, number - take
                parts[0][1] -= take
                if not parts[0][1]:
                    parts.pop(0)
        return out

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self._rooms, length)
            if at == len(self._rooms):
                fresh = -(-count // (self.capacity // length))
                self._leave(self.capacity, self.sequences, fresh)
                self.sequences += fresh
                continue
            room = self._rooms[at]
            first, number = self._room[room].pop()
            take = min(number, count)
            if take < number:
                self._room[room].append((first + take, number - take))
            elif not self._room[room]:
                self._rooms.pop(at)
            self._put(length, take, first, self.capacity - room)
            self._leave(room - length, first, take)
            count -= take


def _look_up(keys: np.ndarray, columns: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            first_rank, first, offset = columns[:, at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first + rank - first_rank), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return tidy(run)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, bucket_rows: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = durable(pieces(docs, tokenizer, capacity))
    histogram = {int(r["length"]): r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(histogram, capacity, groups)
    table = np.array(sorted(plan.segments), np.int64).reshape(-1, 5)
    keys, columns = (table[:, 0] << 44) + table[:, 1], np.ascontiguousarray(table[:, [1, 3, 4]].T)

    buckets = max(8, -(-sum(histogram.values()) // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("within", within).join(bases, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within") - 1).alias("rank"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_look_up(keys, columns), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

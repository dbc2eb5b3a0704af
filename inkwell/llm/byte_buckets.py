"""Operator 10: repeated byte strings by bucket-pointer refinement.

Suffixes start in buckets of equal q-grams and are refined by sorting on the
bucket identifiers of later offsets.  A byte is removed if it lies in a string
of LENGTH bytes that also starts anywhere else, in its own text or another.

1. Initial buckets: q-grams at content-chosen positions (see repeats).  A
   bucket of one is finished; equal longer stretches of one bucket are counted
   as one with a number of copies, as they are copies whole.
2. Blocks of positions left are cut into steps of STEP positions at fixed
   distances from their q-gram and refined the same way: by the bytes that all
   strings of a step share, then by all bytes they cover.
3. Positions still left go, with their strings, to the task of their string's
   hash.  There buckets of 8-byte grams are numbered, and each pass sorts the
   positions of a bucket by the bucket number one depth further on, which
   doubles the depth; numbers of one pass are the keys of the next, so each is
   reused by all positions before it, and a position alone in its bucket is
   finished.  Buckets of LENGTH bytes with another position repeat.  This step
   compares bytes, not hashes.

In each round a task first settles equal positions of its own and sends one,
so a very frequent string is a row a task.  Steps 1 and 2 compare 64-bit hashes
within a bucket of equal 64-bit q-gram hashes; a sum of powers modulo 2**64
cannot cancel out over the at most 2 * LENGTH - GRAM bytes that a stretch has
(arrangements that do so are 512 bytes long at least).

Defined results: a null text is empty; rows that repeat a document count as
two places, so both go; a null doc_id is an id like another; ids that are no
integers raise an error; matches never cross documents; other columns are kept
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import repeats, textkit
from inkwell.llm.columns import aside, back
from inkwell.llm.repeats import ID, KEY

LENGTH = 200
GRAM = 40
STEP = 8
_FINAL = (("h1", pa.int64()), ("h2", pa.int64()), (ID, pa.int64()), (KEY, pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("f", pa.int8()), ("s", pa.binary()))
COMPARED_ROWS = 1 << 16


def final_buckets(data: np.ndarray, which: int, length: int = LENGTH) -> np.ndarray:
    """A hash of the string of `length` bytes at every offset, by doubling the depth three times; it says which task a position goes to."""
    depth = length // 8
    ids = textkit.mix(textkit.Rolling(textkit.byte_symbols(data, which), which).grams(depth))
    while depth < length:
        ids = textkit.mix(ids[: len(ids) - depth] * np.uint64(0x9FB21C651E98DF25) + ids[depth:])
        depth *= 2
    return ids


def _settle(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    h1, h2, i, t, at, strings = rows
    order = np.lexsort((h2, h1))
    h1, h2, i, t, at = (x[order] for x in (h1, h2, i, t, at))
    same = repeats._runs(h1, h2)
    size = np.diff(np.append(same, len(h1)))
    ask = same  # one position of each bucket asks for the rest of the corpus
    hit = repeats._spread(size > 1, same, len(h1))
    lo, hi, row = _stretches(i[hit], t[hit], at[hit])
    pi, pt = i[hit][row], t[hit][row]
    deal = repeats.dealt_by_text(pi, pt)
    f = np.concatenate([np.where(size > 1, repeats.MULTI, repeats.CANDIDATE), np.full(len(lo), repeats.SETTLED)])
    arrays = [np.concatenate(x) for x in ((h1[ask], deal), (h2[ask], np.zeros(len(lo), np.uint64)), (i[ask], pi), (t[ask], pt), (at[ask], lo), (at[ask], hi))]
    kinds = [kind for _, kind in _FINAL[:-1]]
    own = np.ascontiguousarray(strings[order[ask]])
    sent = pa.FixedSizeBinaryArray.from_buffers(pa.binary(own.shape[1]), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
    asked = pa.concat_arrays([sent, pa.array([b""] * len(lo), pa.binary())])
    order = np.lexsort((arrays[4], arrays[3], arrays[2]))  # neighbours of one text together: they compress well
    made = [x[order] for x in (arrays[0].view(np.int64), arrays[1].view(np.int64), *arrays[2:], f)]
    columns = [pa.array(a.astype(k.to_pandas_dtype()), k) for a, k in zip(made, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, asked.take(pa.array(order))], [n for n, _ in _FINAL])


def _numbered(own: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket numbers of pairs (own bucket, bucket of a later offset), by sorting."""
    order = np.lexsort((later, own))
    new = np.ones(len(own), bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (later[order][1:] != later[order][:-1])
    out = np.empty(len(own), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def refined(strings: np.ndarray) -> np.ndarray:
    """Which rows of a matrix of bytes (its width a multiple of 8) equal another row.

    Column j of a pass holds the buckets of the grams that start 8 * j bytes
    in; a pass sorts them by the buckets one depth further on.
    """
    n, lanes = len(strings), strings.shape[1] // 8
    out, left = np.zeros(n, bool), np.arange(n)
    grams = np.unique(strings.view("<u8").ravel(), return_inverse=True)[1].reshape(n, lanes)
    levels = {1: grams}  # depth in lanes -> buckets at every multiple of that depth
    depth, whole, covered = 1, grams[:, 0], 1

    def alone(buckets: np.ndarray) -> np.ndarray:
        return np.bincount(buckets, minlength=1)[buckets] == 1

    while len(left) and covered < lanes:
        stay = ~alone(whole)  # a position alone in its bucket is finished
        left, whole = left[stay], whole[stay]
        levels = {d: x[stay] for d, x in levels.items()}
        if not len(left):
            return out
        if covered == depth and 2 * depth <= lanes:
            held = levels[depth]
            pairs = held.shape[1] // 2
            made = [_numbered(held[:, 2 * j], held[:, 2 * j + 1]) for j in range(1, pairs)]
            own = _numbered(held[:, 0], held[:, 1])
            # Numbers of one column mean nothing in another, but rows are compared column by column only.
            depth *= 2
            levels[depth] = np.stack([own, *made], axis=1)
            whole, covered = own, depth
        else:  # the rest of the width, by the deepest buckets that fit
            d = max(d for d in levels if covered + d <= lanes and covered % d == 0)
            whole, covered = _numbered(whole, levels[d][:, covered // d]), covered + d
    out[left[~alone(whole)]] = True
    return out


def _stretches(i: np.ndarray, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions as stretches within each text: (first, last, a row of the text)."""
    order = np.lexsort((at, t, i))
    i, t, at = i[order], t[order], at[order]
    if not len(at):
        return at, at, order
    cut = np.flatnonzero((i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + 1))
    begin = np.concatenate([[0], cut + 1])
    return at[begin], at[np.concatenate([cut, [len(at) - 1]])], order[begin]


def _steps(length: int):
    """Open blocks in steps of STEP positions: (bytes that all strings of a step share, all bytes they cover)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = repeats.Held(lambda rows: repeats.settle_locally(rows, earlier=False))
        for batch in batches:
            ids, keys = (np.asarray(batch.column(c)) for c in (ID, KEY))
            raw, off, _ = textkit.column_bytes(batch.column("__rp_text"))
            for row, lo, hi, anchor in repeats.open_blocks(batch):
                rolling = textkit.Rolling(textkit.byte_symbols(raw[off[row] : off[row + 1]]))
                size = hi - lo + 1
                block = np.repeat(np.arange(len(lo)), size)
                starts = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size) + lo[block]
                step = (anchor[block] - starts) // STEP
                begin = repeats._runs(block, step)
                u, v = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
                step, anchored = step[begin], anchor[block[begin]]
                core = anchored - step * STEP
                deal = step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                k = textkit.mix(rolling.spans(core, core + length - STEP + 1) + deal)
                place = ((anchored - u) * 256 + (anchored - v)).astype(np.uint64)
                s = textkit.mix(rolling.spans(u, v + length) + place * np.uint64(0xD6E8FEB86659FD93))
                n = len(u)
                yield from held.add(k, s, np.full(n, ids[row]), np.full(n, keys[row]), u, v, np.zeros(n, np.int64))
        yield from held.rest()

    return run


def _refine(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = repeats.Held(_settle, COMPARED_ROWS)
        for batch in batches:
            ids, keys = (np.asarray(batch.column(c)) for c in (ID, KEY))
            raw, off, _ = textkit.column_bytes(batch.column("__rp_text"))
            for row, starts in repeats.open_starts(batch):
                data = raw[off[row] : off[row + 1]]
                h1, h2 = (final_buckets(data, which, length)[starts] for which in (0, 1))
                for k in range(0, len(starts), COMPARED_ROWS):
                    some = slice(k, k + COMPARED_ROWS)
                    part = starts[some]
                    strings = np.lib.stride_tricks.sliding_window_view(data, length)[part]
                    yield from held.add(h1[some], h2[some], np.full(len(part), ids[row]), np.full(len(part), keys[row]), part, strings)
        yield from held.rest()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in repeats.by_whole_keys(batches, tuple(n for n, _ in _FINAL), COMPARED_ROWS):
        asks = rows["f"] < repeats.SETTLED
        order, done = np.flatnonzero(asks), np.flatnonzero(~asks)
        new = order[:0]
        if len(order):
            strings = np.frombuffer(b"".join(rows["s"][order]), np.uint8).reshape(len(order), -1)
            new = order[refined(strings) & (rows["f"][order] == repeats.CANDIDATE)]
        lo, hi, row = _stretches(rows[ID][new], rows[KEY][new], rows["lo"][new].astype(np.int64))
        out = {ID: (rows[ID][new][row], rows[ID][done]), KEY: (rows[KEY][new][row], rows[KEY][done]), "lo": (lo.astype(np.int32), rows["lo"][done]), "hi": (hi.astype(np.int32), rows["hi"][done])}
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out.values()], list(out))


def repeated_starts(source: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per text of repeats.identified(), __rp_hits: stretches [lo, hi] of offsets at which a repeated string of `length` bytes starts."""
    if length % 8 or length > 255:
        raise ValueError("length must be a multiple of 8 below 256")
    first = repeats.first_round(source, repeats.byte_rows, length, gram, earlier=False)
    second = repeats.settle(repeats.open_texts(source, first).mapInArrow(_steps(length), repeats.ROWS), earlier=False)
    schema = f"h1 long, h2 long, {ID} long, {KEY} long, lo int, hi int, f byte, s binary"
    final = repeats.open_texts(source, second).mapInArrow(_refine(length), schema)
    later = final.repartition("h1").sortWithinPartitions("h1").mapInArrow(_compare, f"{ID} long, {KEY} long, lo int, hi int")
    return repeats.all_stretches(first, second, later)


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = textkit.column_bytes(batch.column("__rp_text"))
            n, removed, spans, sha = [], [], [], []
            for row, hits in enumerate(batch.column("__rp_hits")):
                data = raw[off[row] : off[row + 1]]
                gone = repeats.hit_mask(hits, length, len(data))
                n.append(len(data))
                if gone is None:
                    removed.append(0)
                    spans.append(0)
                else:
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                    data = data[~gone]
                sha.append(hashlib.sha256(data.tobytes()).hexdigest())
            own = [pa.array(x, pa.int64()) for x in (n, removed, spans)] + [pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("__rp_doc"), *own], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is left."""
    source = repeats.identified(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_hits(source, repeated_starts(source, length)).mapInArrow(_digest(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character cut in half is dropped."""
    given, docs = docs, aside(docs, "doc_id", "text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, null = textkit.column_bytes(batch.column("text"))
            out = []
            for row, hits in enumerate(batch.column("__rp_hits")):
                data = raw[off[row] : off[row + 1]]
                gone = repeats.hit_mask(hits, length, len(data))
                out.append(None if null[row] else (data if gone is None else data[~gone]).tobytes().decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields], schema.names)

    return back(repeats.documents_with_hits(docs, repeated_starts(repeats.identified(docs), length)).mapInArrow(run, schema), given, ("doc_id", "text"))

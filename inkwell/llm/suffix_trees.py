"""Operator 6: repeated word sequences by prefix-partitioned suffix trees.

A word is removed if it lies in a window of DEPTH words whose sequence also
starts in a document with a smaller doc_id.

1. Suffixes that cannot repeat, and those that whole blocks settle, are found
   by their anchors (see repeats); the suffixes left start at every window of
   the open blocks, written as the identifiers of their first DEPTH words.
   Each task keeps one of equal suffixes, the one of its smallest doc_id.
2. The suffixes are partitioned by prefixes of variable length: a range
   partitioning on the identifier sequence cuts where a sample says that a
   group reaches GROUP_SUFFIXES, after one word where words are rare and
   deeper where they are frequent.  A group fits in memory, and no subtree
   below a cut spans two groups.
3. A group's suffixes, sorted, with the lengths of their common prefixes, are
   its subtree: an internal node of depth d is a stretch with common prefixes
   of d words or more.  Nodes of depth DEPTH or more are the repeats; each
   leaf but those of the node's smallest doc_id starts a removed window.
   Windows of neighbouring suffixes merge into maximal repeats.

Word identifiers are 64-bit hashes, so windows that differ in one word only are
still told apart by 64 bits.

Defined results: a null text has no words; rows that repeat a doc_id never
remove each other; a null doc_id is smaller than all others; windows never
cross documents; other columns are kept whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import byte_buckets, repeats, textkit
from inkwell.llm.columns import aside, back
from inkwell.llm.repeats import ID, KEY

DEPTH = 13
GRAM = 5
GROUP_SUFFIXES = 250_000
WORD_BYTES = 8
_LEAVES = ("suffix", ID, KEY, "lo", "hi", "f")
SCHEMA = f"suffix binary, {ID} long, {KEY} long, lo int, hi int, f byte"


def _leaves(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """One task's suffixes: later documents' equal ones are settled, the first one stays and asks."""
    suffixes, i, t, at = rows
    order = np.lexsort((at, i, suffixes))
    suffixes, i, t, at = (x[order] for x in rows)
    same = np.flatnonzero(np.concatenate([[True], suffixes[1:] != suffixes[:-1]]))
    gone = i > repeats._spread(i[same], same, len(i))
    lo, hi, row = byte_buckets._stretches(i[gone], t[gone], at[gone])
    # Settled stretches only travel; a hash of the text in place of a suffix deals them out.
    deal = repeats.dealt_by_text(i[gone][row], t[gone][row]).byteswap().view("S8").tolist() if len(row) else []
    asking = suffixes[~gone].view(np.uint8).reshape(-1, suffixes.itemsize)
    kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(suffixes.itemsize), len(asking), [None, pa.py_buffer(np.ascontiguousarray(asking))]).cast(pa.binary())
    stay = ~gone
    rest = [np.concatenate(x) for x in ((i[stay], i[gone][row]), (t[stay], t[gone][row]), (at[stay].astype(np.int32), lo.astype(np.int32)), (at[stay].astype(np.int32), hi.astype(np.int32)))]
    f = np.concatenate([np.full(int(stay.sum()), repeats.CANDIDATE, np.int8), np.full(len(lo), repeats.SETTLED, np.int8)])
    return pa.RecordBatch.from_arrays([pa.concat_arrays([kept, pa.array(deal, pa.binary())]), *map(pa.array, rest), pa.array(f)], list(_LEAVES))


def _suffixes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = repeats.Held(_leaves, repeats.FLUSH_ROWS // 2)
        size = WORD_BYTES * depth
        for batch in batches:
            ids, keys = (np.asarray(batch.column(c)) for c in (ID, KEY))
            raw, off, _ = textkit.column_bytes(batch.column("__rp_text"))
            for row, starts in repeats.open_starts(batch):
                data = raw[off[row] : off[row + 1]]
                words, _ = repeats.word_rows(data, np.array([0, len(data)]))
                short = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).ravel()
                view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(short, size)[starts * WORD_BYTES]).view(f"S{size}").ravel()
                yield from held.add(view, np.full(len(starts), ids[row]), np.full(len(starts), keys[row]), starts)
        yield from held.rest()

    return run


def common_prefixes(suffixes: np.ndarray) -> np.ndarray:
    """For sorted suffixes (rows of word identifiers): how many first words each shares with the one before."""
    out = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        differs = suffixes[1:] != suffixes[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), suffixes.shape[1])
    return out


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, last leaf + 1) of the topmost internal nodes of at least `depth` words in a subtree."""
    inside = common >= depth
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) - 1
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    return begin, end


def _subtrees(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = np.asarray(batch.column("f")) == repeats.SETTLED
            yield batch.filter(pa.array(done)).select([ID, KEY, "lo", "hi"])
            held.append(batch.filter(pa.array(~done)))
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)  # the group, in order: at most about GROUP_SUFFIXES leaves
        suffixes = np.frombuffer(b"".join(table.column("suffix").to_pylist()), f"V{WORD_BYTES}").reshape(-1, depth)
        i, t, at = (np.asarray(table.column(c)) for c in (ID, KEY, "lo"))
        common = common_prefixes(suffixes)
        gone = np.zeros(len(i), bool)
        for begin, end in zip(*deep_nodes(common, depth), strict=True):
            gone[begin:end] = i[begin:end] > i[begin:end].min()
        lo, hi, row = byte_buckets._stretches(i[gone], t[gone], at[gone].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i[gone][row], t[gone][row], lo.astype(np.int32), hi.astype(np.int32))], [ID, KEY, "lo", "hi"])

    return run


def repeated_starts(source: DataFrame, depth: int = DEPTH, gram: int = GRAM, group: int = GROUP_SUFFIXES) -> DataFrame:
    """Per text of repeats.identified(), __rp_hits: stretches [lo, hi] of words at which a window starts that an earlier document has."""
    rounds = repeats.first_round(source, repeats.word_rows, depth, gram, earlier=True)
    leaves = repeats.open_texts(source, rounds).mapInArrow(_suffixes(depth), SCHEMA)
    n_leaves = rounds.where(F.col("f") == repeats.OPEN).agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    groups = max(1, -(-n_leaves // group))
    trees = leaves.repartitionByRange(groups, "suffix").sortWithinPartitions("suffix").mapInArrow(_subtrees(depth), f"{ID} long, {KEY} long, lo int, hi int")
    return repeats.all_stretches(rounds, trees)


def _digest(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = textkit.column_bytes(batch.column("__rp_text"))
            n, removed, sha = [], [], []
            for row, hits in enumerate(batch.column("__rp_hits")):
                words = raw[off[row] : off[row + 1]].tobytes().split()
                n.append(len(words))
                gone = repeats.hit_mask(hits, depth, len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("__rp_doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def digest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the words left."""
    source = repeats.identified(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_hits(source, repeated_starts(source, depth)).mapInArrow(_digest(depth), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the repeated words cut out of text; changed texts have single spaces between words."""
    given, docs = docs, aside(docs, "doc_id", "text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = textkit.column_bytes(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for row, hits in enumerate(batch.column("__rp_hits")):
                words = raw[off[row] : off[row + 1]].tobytes().split()
                gone = repeats.hit_mask(hits, depth, len(words))
                if gone is not None:
                    texts[row] = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields], schema.names)

    return back(repeats.documents_with_hits(docs, repeated_starts(repeats.identified(docs), depth)).mapInArrow(run, schema), given, ("doc_id", "text"))

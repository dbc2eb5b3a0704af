"""Shared first round of the two exact repeat operators (6 and 10).

Both ask which windows of `width` symbols (words or bytes) occur a second time.
Every window is represented by content-chosen positions: of the `gram`-symbol
stretches inside a window the one with the smallest hash is its anchor, so
equal windows have equal anchors and about 2 / (width - gram + 2) of all
positions are one.  Neighbouring windows with one anchor form a block, known
by its anchor's gram (key) and by all the symbols its windows cover (span):

* a key that occurs once has no repeated window: its blocks are settled;
* blocks with equal spans repeat each other whole: settled without looking
  into them, which is nearly everything in copies and near copies;
* only blocks whose key occurs with several spans stay open, and the
  operators compare their windows one by one.

Before anything is shuffled, each task settles what its own rows settle and
sends one row for equal ones; a key with many spans in one task is declared
open there and sends one row.  So neither a text nor a passage that is in a
third of all documents makes a large group anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkwell.llm import textkit
from inkwell.llm.durable import durable

FLUSH_ROWS = 1 << 19
HOT_SPANS = 8
_PLACE = np.uint64(2**24 - 1)
CANDIDATE, MULTI, HOT, SETTLED, OPEN = range(5)
ID, KEY = "__rp_id", "__rp_key"
_FIELDS = (("k", pa.int64()), ("s", pa.int64()), (ID, pa.int64()), (KEY, pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p", pa.int16()), ("f", pa.int8()))
ROWS = f"k long, s long, {ID} long, {KEY} long, lo int, hi int, p short, f byte"
BLOCKS = f"{ID} long, {KEY} long, lo int, hi int, p short, f byte"

#: From one block of texts to (symbols of all rows, offset of each row among them).
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return textkit.byte_symbols(data), offsets


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, words = textkit.word_spans(data, offsets)
    return textkit.word_hashes(data, starts, ends), words


def _names(docs: DataFrame) -> DataFrame:
    """docs plus doc_id as a number (null: below all others) and a 64-bit hash that tells different texts of one id apart."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column; give other ids a number first")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    key = F.coalesce(F.xxhash64(F.lit(3), F.col("text")), F.lit(0).cast("long"))
    return docs.withColumn(ID, number).withColumn(KEY, key)  # never null: inner and outer joins see one plan of the texts


def identified(docs: DataFrame) -> DataFrame:
    """The columns that every step reads; one shape, so that a plan shuffles the texts once."""
    return _names(docs).select(ID, KEY, F.col("doc_id").alias("__rp_doc"), F.col("text").alias("__rp_text"))


def blocks_of(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """(row, first start, last start, anchor, key, span) of every block of every row; places count within the row."""
    n, inner = len(symbols), width - gram + 1
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = textkit.Rolling(symbols)
    grams = textkit.mix(rolling.grams(gram))
    place = np.arange(len(grams), dtype=np.uint64)
    # The upper bits decide; the place below them settles ties (the first wins) and says where the anchor is.
    least = textkit.sliding((grams & ~_PLACE) | (place & _PLACE), inner)
    crossing = np.zeros(n + 1, np.int32)
    sizes, ends = np.diff(offsets), offsets[1:]
    np.add.at(crossing, np.maximum(offsets[:-1], ends - width + 1)[sizes > 0], 1)
    np.add.at(crossing, ends[sizes > 0], -1)
    starts = np.flatnonzero(np.cumsum(crossing[:-1])[: len(least)] == 0)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchors = starts + ((least[starts] - starts.astype(np.uint64)) & _PLACE).astype(np.int64)
    begin = _runs(anchors)
    lo, hi, anchors = starts[begin], starts[np.append(begin[1:], len(starts)) - 1], anchors[begin]
    row = np.searchsorted(offsets, lo, side="right") - 1
    spans = textkit.mix(rolling.spans(lo, hi + width) + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row, lo - offsets[row], hi - offsets[row], anchors - offsets[row], grams[anchors], spans


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the stretches of equal rows in sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    if len(change):
        change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _spread(per_run: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.append(starts, n)))


def dealt_by_text(i: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Where rows that only travel go: those of one text together, those of one id (or of none) apart."""
    return textkit.mix(i.view(np.uint64) + t.view(np.uint64))


def settle_locally(rows: tuple[np.ndarray, ...], earlier: bool) -> pa.RecordBatch:
    """One task's blocks: what they settle among themselves, and one candidate for equal ones."""
    k, s, i, t, lo, hi, p = rows
    order = np.lexsort((lo, i, s, k))
    k, s, i, t, lo, hi, p = (x[order] for x in rows)
    n = len(k)
    same = _runs(k, s)
    size = _spread(np.diff(np.append(same, n)), same, n)
    first = np.zeros(n, bool)
    first[same] = True
    f = np.full(n, CANDIDATE)
    if earlier:
        f[i > _spread(i[same], same, n)] = SETTLED
    else:
        f[size > 1] = SETTLED
    by_key = _runs(k)
    hot = _spread(np.add.reduceat(first, by_key), by_key, n) > HOT_SPANS
    f[hot & (f == CANDIDATE)] = OPEN
    rows = (k, s, i, t, lo, hi, p)
    parts = [(*rows, f)]
    if not earlier:  # one of the equal ones stands for them; a hot key's are open as witnesses
        stand = first & (size > 1)
        parts.append((*(x[stand] for x in rows), np.where(hot[stand], OPEN, MULTI)))
    lead = np.zeros(n, bool)
    lead[by_key] = True
    lead &= hot
    parts.append((*(x[lead] for x in rows), np.full(int(lead.sum()), HOT)))
    k, s, i, t, lo, hi, p, f = (np.concatenate(x) for x in zip(*parts, strict=True))
    passing = f >= SETTLED  # settled rows only travel: dealt out by text, in runs
    k = np.where(passing, dealt_by_text(i, t), k)
    s = np.where(passing, np.uint64(0), s)
    order = np.lexsort((lo, t, i))  # neighbours of one text together: they compress well
    arrays = [x[order] for x in (k.view(np.int64), s.view(np.int64), i, t, lo, hi, p, f)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, (_, kind) in zip(arrays, _FIELDS, strict=True)], [name for name, _ in _FIELDS])


class Held:
    """Rows of a task, settled and handed on whenever enough have come."""

    def __init__(self, settle, most: int = FLUSH_ROWS):
        self.settle, self.most, self.rows, self.count = settle, most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(columns)
        self.count += len(columns[0])
        if self.count >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            yield self.settle(tuple(np.concatenate(x) for x in zip(*self.rows, strict=True)))
        self.rows, self.count = [], 0


def _map(symbols: Symbols, width: int, gram: int, earlier: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(lambda rows: settle_locally(rows, earlier))
        for batch in batches:
            ids, keys = (np.asarray(batch.column(c)) for c in (ID, KEY))
            for a, _, data, offsets in textkit.blocks(batch.column("__rp_text")):
                row, lo, hi, at, k, s = blocks_of(*symbols(data, offsets), width, gram)
                yield from held.add(k, s, ids[a + row], keys[a + row], lo, hi, at - lo)
        yield from held.rest()

    return run


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def by_whole_keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int = FLUSH_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by names[0], in pieces that never cut a key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= most:
            keys = np.asarray(batch.column(names[0]))
            cut = int(np.searchsorted(keys, np.asarray(held[-1].column(names[0]))[-1], side="right"))
            if cut < batch.num_rows:
                held.append(batch.slice(0, cut))
                yield {c: np.concatenate([_array(b.column(c)) for b in held]) for c in names}
                held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield {c: np.concatenate([_array(b.column(c)) for b in held]) for c in names}


_KEPT = (ID, KEY, "lo", "hi", "p", "f")


def _reduce(earlier: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_whole_keys(batches, tuple(name for name, _ in _FIELDS)):
            asks = rows["f"] < SETTLED
            done = {c: v[~asks] for c, v in rows.items()}
            rows = {c: v[asks] for c, v in rows.items()}
            order = np.lexsort((rows["lo"], rows[ID], rows["s"], rows["k"]))
            k, s, i, f = (rows[c][order] for c in ("k", "s", ID, "f"))
            n = len(k)
            by_key, same = _runs(k), _runs(k, s)
            first = np.zeros(n, bool)
            first[same] = True
            mixed = np.zeros(n, bool)
            if n:
                mixed = _spread((np.add.reduceat(first, by_key) > 1) | (np.add.reduceat(f == HOT, by_key) > 0), by_key, n)
            if earlier:
                settled = i > _spread(i[same], same, n)
                is_open = ~settled & mixed & (f != HOT)
            else:
                size = _spread(np.diff(np.append(same, n)), same, n)
                settled = (size > 1) & (f != MULTI)
                known = _spread(np.logical_or.reduceat(f == HOT, same) if n else np.empty(0, bool), same, n)
                is_open = first & mixed & ~known
            out = []
            for mask, role in ((settled, SETTLED), (is_open, OPEN)):
                at = order[mask]
                out.append([rows[c][at] for c in _KEPT[:-1]] + [np.full(len(at), role, np.int8)])
            out.append([done[c] for c in _KEPT])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], list(_KEPT))

    return run


def settle(rows: DataFrame, earlier: bool) -> DataFrame:
    """Rows of settle_locally() from all tasks, settled across tasks and kept in the shared folder."""
    return durable(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_reduce(earlier), BLOCKS))


def first_round(source: DataFrame, symbols: Symbols, width: int, gram: int, earlier: bool) -> DataFrame:
    """Settled and open blocks (ID, KEY, lo, hi, p, f).

    source comes from identified(); earlier: only occurrences in a document of
    a smaller id count, and the first document's blocks are not settled.
    """
    return settle(source.mapInArrow(_map(symbols, width, gram, earlier), ROWS), earlier)


def open_texts(source: DataFrame, rounds: DataFrame) -> DataFrame:
    """The texts that have open blocks, with the blocks (lo, hi, anchor from lo)."""
    opened = rounds.where(F.col("f") == OPEN).groupBy(ID, KEY).agg(F.collect_list(F.struct("lo", "hi", "p")).alias("__rp_open"))
    return source.join(opened, [ID, KEY])


def open_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of open_texts: (row, first starts, last starts, anchors)."""
    lists = batch.column("__rp_open")
    flat = lists.flatten()
    lo, hi, p = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi", "p"))
    ends = np.cumsum(np.asarray(lists.value_lengths()))
    for row, end in enumerate(ends):
        begin = 0 if row == 0 else ends[row - 1]
        some = slice(begin, end)
        yield row, lo[some], hi[some], lo[some] + p[some]


def open_starts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of open_texts its window starts, each once."""
    for row, lo, hi, _ in open_blocks(batch):
        yield row, np.flatnonzero(textkit.covered(lo, hi + 1, int(hi.max()) + 1))


def as_stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as stretches [lo, hi] without gaps."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def all_stretches(*found: DataFrame) -> DataFrame:
    """Per text all stretches of repeated window starts: __rp_hits.  Rounds give what they settled."""
    out = None
    for rows in found:
        rows = (rows.where(F.col("f") == SETTLED) if "f" in rows.columns else rows).select(ID, KEY, "lo", "hi")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(ID, KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("__rp_hits"))


def with_hits(source: DataFrame, hits: DataFrame) -> DataFrame:
    """Every row of identified(), with __rp_hits (null: nothing repeated)."""
    return source.join(hits, [ID, KEY], "left")


def documents_with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The same for all columns of docs."""
    return _names(docs).join(hits, [ID, KEY], "left")


def hit_mask(hits: pa.ListScalar, width: int, n: int) -> np.ndarray | None:
    """Which of n symbols a repeated window covers; None: none."""
    if not hits.is_valid or not len(hits.values):
        return None
    lo, hi = (np.asarray(hits.values.field(c)).astype(np.int64) for c in ("lo", "hi"))
    return textkit.covered(lo, hi + width, n)



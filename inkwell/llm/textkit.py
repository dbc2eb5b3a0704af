"""Vectorised text helpers that run inside Arrow tasks.

Everything works on blocks: a few consecutive rows of one Arrow batch, seen as
one array of UTF-8 bytes plus row offsets.  A block holds about a megabyte (one
row if that row alone is longer), so the scratch arrays of a task stay small
whatever the batch size is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Odd and 3 mod 8, so that differences of powers keep all but a few low bits.
_BASES = (np.uint64(0x9E3779B97F4A7C13 | 3), np.uint64(0xC2B2AE3D27D4EB4B))
_TABLES = tuple(np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 23))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse, modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        out = []
        for base in (int(_BASES[which]) | 1, _inverse(int(_BASES[which]) | 1)):
            table = np.empty(size, np.uint64)
            table[0] = 1
            table[1:] = np.uint64(base)
            out.append(np.multiply.accumulate(table))
        have = _POWERS[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xorshift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a symbol sequence from prefix sums."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        up, self.down = powers(which, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def grams(self, width: int) -> np.ndarray:
        """The hash of symbols[i : i + width] for every i that has them all."""
        n = len(self.prefix) - 1 - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.prefix[width:] - self.prefix[:n]) * self.down[:n]


def byte_symbols(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLES[which][data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary column."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    return raw, off, null


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets from 0) over a column; null rows are empty."""
    raw, off, _ = column_bytes(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the word offset of each row; breaks says which bytes end a word (else [\\x20\\x09-\\x0D])."""
    word = ~breaks[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LANE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LONG_WORD = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end) of bytes.

    Eight bytes at a time go through the finaliser, so no arrangement of the
    bytes cancels out (as it would in a sum of powers modulo 2**64).
    """
    sizes = (ends - starts).astype(np.int64)
    out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, off = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD)), 0
    while len(at):
        rest = sizes[at] - off
        lane = lanes[starts[at] + off] & _LANE_MASKS[np.minimum(rest, 8)]
        out[at] = mix((out[at] ^ lane) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(off))
        off += 8
        at = at[rest > 8]
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


_CHAIN = np.random.default_rng(31).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chained(symbols: np.ndarray, width: int) -> np.ndarray:
    """The hash of symbols[i : i + width] for every i that has them all; each place has a multiplier of its own."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = symbols[:n] * _CHAIN[0]
    for k in range(1, width):
        out += symbols[k : k + n] * _CHAIN[k]
    return mix(out)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The best of values[i : i + width] for every i that has them all, in linear time."""
    n = len(values)
    if width == 1 or n < width:
        return values[: max(0, n - width + 1)]
    full = -(-n // width) * width
    fill = np.iinfo(values.dtype).max if best is np.minimum else np.iinfo(values.dtype).min
    padded = np.full(full, fill, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    head = best.accumulate(grid, axis=1).ravel()
    tail = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(tail[: n - width + 1], head[width - 1 : n])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the stretches [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0

"""Vectorised word cutting and hashing over Arrow string columns.

Texts are handled as UTF-8 bytes.  Every separator used by the operators is
ASCII, and so is every letter that they fold, so byte tables are exact.  All
functions work on pieces of a few MB of text, which bounds a task's memory by
the piece (or by one text, where that is longer), not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
PIECE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C55
_SHIFT = 0xD1342543DE82EF95
_M64 = (1 << 64) - 1


def white_table() -> np.ndarray:
    """True for bytes of a word ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of a word ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after lower-casing."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


WHITE, ALNUM, LOWER = white_table(), alnum_table(), lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` parts a hash belongs to; by bits that its low 48 don't hold, as far as these tell so many apart."""
    return ((h >> np.uint64(48 if n <= 1 << 16 else 36)) % np.uint64(n)).astype(np.int32)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the worker's next piece."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[base]
    return up[:n], down[:n]


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, the same wherever the span lies."""
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(base, len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up, out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


class Piece:
    """Some consecutive rows of a batch, cut into words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray | None):
        self.first, self.rows = first, len(offsets) - 1
        self.data = fold[data] if fold is not None else data
        self.offsets = offsets
        inside = table[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, inside
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, inside
        after[edge] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        #: self.bounds[i]:self.bounds[i + 1] are the words of row i.
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    def hashes(self, base: int = _BASE) -> np.ndarray:
        """A 64-bit hash of each word; some words at a time, so that a long text takes no more memory than a short one."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE_BYTES, side="right")))
            a, b = self.start[i], self.end[j - 1]
            out[i:j] = mix(_spans(self.data[a:b].astype(np.uint64) + np.uint64(1), base, self.start[i:j] - a, self.end[i:j] - a))
            i = j
        return out

    def windows(self, words: np.ndarray, size: int, base: int = _SHIFT) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all windows of ``size`` words within a row, and the windows' hashes."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        row_end = np.repeat(self.bounds[1:], self.count)
        at = np.flatnonzero(np.arange(len(words)) + size <= row_end)
        return at, mix(_spans(words, base, at, at + size) + np.uint64(size))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row, counted from this piece's first, of each word place."""
        return np.searchsorted(self.bounds, at, side="right") - 1


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, table: np.ndarray, fold: np.ndarray | None = None, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's rows in order, in pieces of at most ``most`` bytes or one row."""
    data, offsets = raw(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        part = offsets[first : last + 1]
        yield Piece(first, data[part[0] : part[-1]], part - part[0], table, fold)
        first = last


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 2 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without a copy, to at most ``most`` bytes of text or one row each."""
    for batch in batches:
        _, offsets = raw(batch.column(text_at))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows of (key, text) gathered, over batches, to blocks of about ``size`` bytes of text or one row: (keys, UTF-8 bytes, row offsets)."""
    keys, data, ends, held = [], [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        flat, offsets = raw(batch.column(1))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size - held, side="right")) - 1
            if last <= first and held:  # the next text doesn't fit
                yield keys, np.concatenate(data), np.concatenate(ends)
                keys, data, ends, held = [], [], [np.zeros(1, np.int64)], 0
                continue
            last = max(last, first + 1)
            keys += batch.column(0).slice(first, last - first).to_pylist()
            data.append(flat[offsets[first] : offsets[last]].copy())
            ends.append(offsets[first + 1 : last + 1] - offsets[first] + held)
            held += len(data[-1])
            first = last
    if keys:
        yield keys, np.concatenate(data), np.concatenate(ends)


def begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)

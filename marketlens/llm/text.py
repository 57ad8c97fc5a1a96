"""Vectorised helpers for the text of one Arrow batch, seen as one run of UTF-8 bytes.

The helpers never look at one document at a time: a block of documents is one uint8 array plus offsets, and words,
lines, hashes and minima are array operations over it. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE_VALUES = _odd_numbers(11, 256)
_BASE = int(_odd_numbers(12, 1)[0])


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            out = []
            for b in (self.base, self.inverse):
                a = np.full(max(n, BLOCK_BYTES + 1), b, dtype=np.uint64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Prefix:
    """Prefix sums from which the hash of any run of symbols is one subtraction and one product."""

    def __init__(self, values: np.ndarray):
        n = values.size
        up, self.down = _POWERS.get(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def raw(self, starts, ends) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def runs(self, length: int) -> np.ndarray:
        """Hash of every run of so many symbols, by its start."""
        n = self.sums.size - 1 - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + _U(length))

    def spans(self, starts, ends) -> np.ndarray:
        return mix(self.raw(starts, ends) + (np.asarray(ends) - np.asarray(starts)).astype(np.uint64))


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_BYTE_VALUES[data])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(col: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive blocks."""
    data, offsets = column_bytes(col)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def is_space(data: np.ndarray) -> np.ndarray:
    """Flags of ASCII white space."""
    return _SPACE[data]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of other bytes than those flagged in ``between``) and, per
    document, the index of its first word (n + 1 values)."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    full = offsets[1:] > offsets[:-1]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    firsts, lasts = offsets[:-1][full], offsets[1:][full] - 1
    begin[firsts], end[lasts] = solid[firsts], solid[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and the document of each; an empty document has one empty line."""
    feeds = np.flatnonzero(data == 10)
    doc_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    docs = np.concatenate([np.arange(n), doc_of_feed])
    ends = np.concatenate([feeds, offsets[1:]])
    end_docs = np.concatenate([doc_of_feed, np.arange(n)])
    by, to = np.lexsort((starts, docs)), np.lexsort((ends, end_docs))
    return starts[by], ends[to], docs[by]


def per_document(bounds: np.ndarray) -> np.ndarray:
    """Document index of each item from the per-document first items."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by its start."""
    n = a.size - width + 1
    if n <= 0:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a, span = np.minimum(a[:-span], a[span:]), span * 2
    return np.minimum(a[:n], a[width - span : width - span + n])


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def as_strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())

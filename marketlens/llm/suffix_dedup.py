"""Suffix-array dedup by prefix-free parsing: bytes covered by a 400-byte string that starts twice are removed.

A rolling hash places triggers that cut every document into phrases (``windows``); equal text is parsed equally. The
dictionary holds each different phrase once, with the number of times the parse holds it. Phrases overlap by 399 bytes,
so a 400-byte string never runs past its phrase, and the parse's own suffix order is needed to depth one only: the
phrase itself. The suffix array of the dictionary, with each suffix weighted by its phrase's count in the parse, is
then the corpus order of all 400-byte strings: equal neighbours in it, or a weight above one, are repeats.

The suffix array is built by prefix doubling on exact bytes, in parts dealt out by trigger: equal strings share their
trigger, so each part of the order is complete.

Defined cases: null text is empty: 0 bytes, nothing removed, the hash of nothing. Repeated rows repeat each other's
text, so all of a repeated row of 400 bytes or more goes. A null doc_id is one like any other. A very long text is a
block of its own, and its repeats within itself count. Of equal stretches none is kept: ties need no rule. An empty
table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlens.llm import text as tx
from marketlens.llm import windows
from marketlens.llm.tables import record_batch

LENGTH = 400
#: Bytes that the rolling hash of a trigger reads.
TRIGGER = 128


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different keys."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(keys.size, np.uint64)
    first[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(keys.size, np.uint64)
    out[order] = np.cumsum(first) - 1
    return out


def window_ranks(values: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` symbols within a phrase, and their ranks in suffix order cut at ``length``."""
    size = np.maximum(0, np.diff(bounds) - length + 1)
    of = np.repeat(np.arange(size.size), size)
    starts = np.arange(of.size) - np.repeat(np.cumsum(size) - size, size) + bounds[:-1][of]
    n = values.size
    if values.dtype == np.uint8:  # eight bytes at a time, in their own order
        padded = np.concatenate([values, np.zeros(8, np.uint8)])
        keys, span = np.zeros(n, np.uint64), 8
        for j in range(8):
            keys = (keys << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
        if length < 8:
            keys, span = keys >> np.uint64(8 * (8 - length)), length
    else:
        keys, span = values.astype(np.uint64), 1
    ranks = _ranks(keys)
    while span < length:
        step = min(span, length - span)
        after = np.concatenate([ranks[step:], np.zeros(min(step, n), np.uint64)])[:n]
        ranks = _ranks((ranks << np.uint64(32)) | after)
        span += step
    return starts, ranks[starts]


def resolve(values: np.ndarray, bounds: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Flags of the windows that start twice, from the suffix order of the dictionary and the phrases' counts."""
    flags = np.zeros(values.size, bool)
    starts, ranks = window_ranks(values, bounds, length)
    if starts.size:
        of = np.searchsorted(bounds, starts, side="right") - 1
        total = np.bincount(ranks.astype(np.int64), weights=times[of])
        flags[starts] = total[ranks.astype(np.int64)] > 1
    return flags


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with_text adds the kept bytes."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(2)):
                n = hi - lo
                gone = windows.covered(b.column(3).slice(lo, n), offsets, length)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                full = offsets[1:] > offsets[:-1]
                begin[offsets[:-1][full]] = gone[offsets[:-1][full]]
                counts = np.concatenate([[0], np.cumsum(gone)])
                removed = counts[offsets[1:]] - counts[offsets[:-1]]
                spans = np.concatenate([[0], np.cumsum(begin)])
                left = data[~gone].tobytes()
                ends = np.cumsum(np.diff(offsets) - removed).tolist()
                kept = [left[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                out = [b.column(1).slice(lo, n), np.diff(offsets), removed, spans[offsets[1:]] - spans[offsets[:-1]], [hashlib.sha256(x).hexdigest() for x in kept]]
                yield record_batch(schema, *out, *([pa.array(kept, pa.binary())] if with_text else []))

    return windows.apply_spans(docs, windows.byte_symbols, resolve, length, trigger, "u1", run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

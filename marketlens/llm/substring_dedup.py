"""Substring dedup with suffix automata: words covered by a run of 35 words that starts twice are removed.

The corpus is its own reference. Its phrases (``windows``) that share a trigger with a different phrase are dealt out
by trigger into reference shards. Each shard builds a suffix automaton of its phrases whose states count occurrences,
and streams the phrases through it: the matching statistic at each word is the length of the longest run ending there
that occurs twice, and where it reaches 35 a window is repeated. A shard is sent to the one task that streams the
phrases sharing its triggers, not to every task, so nothing that grows with the corpus is broadcast.

Defined cases: null text has no words: 0 removed, the hash of nothing. Repeated rows repeat each other's text. A null
doc_id is one like any other. A very long text is a block of its own, and its repeats within itself count. Of equal runs
none is kept: ties need no rule. An empty table gives no rows; other columns, of any name, are ignored. Words are
compared unchanged, by 64-bit hash.
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

LENGTH = 35
#: Words that the rolling hash of a trigger reads.
TRIGGER = 10


class SuffixAutomaton:
    """Generalised suffix automaton of several runs of symbols, with weighted occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.count: list[int] = [0]

    def add(self, run: list[int], weight: int) -> None:
        nexts, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for c in run:
            q = nexts[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                p, here = last, length[last] + 1
                fresh = q is None
                if fresh:
                    cur = len(nexts)
                    nexts.append({})
                    link.append(0)
                    length.append(here)
                    count.append(0)
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = cur
                        p = link[p]
                    q = nexts[p][c] if p >= 0 else -1
                if q >= 0:
                    if length[q] == length[p] + 1:
                        to = q
                    else:
                        to = len(nexts)
                        nexts.append(dict(nexts[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        count.append(0)
                        while p >= 0 and nexts[p].get(c) == q:
                            nexts[p][c] = to
                            p = link[p]
                        link[q] = to
                    if fresh:
                        link[cur] = to
                    else:
                        cur = to
                last = cur
            count[last] += weight

    def repeated_lengths(self) -> list[int]:
        """For each state the length of its longest suffix that occurs twice."""
        order = np.argsort(self.length, kind="stable").tolist()
        count, link, length = self.count[:], self.link, self.length
        for s in reversed(order[1:]):
            count[link[s]] += count[s]
        out = [0] * len(count)
        for s in order[1:]:
            out[s] = length[s] if count[s] > 1 else out[link[s]]
        return out

    def matching_statistics(self, run: list[int], lengths: list[int]) -> list[int]:
        """Length of the longest twice-occurring run that ends at each symbol of a run that was added."""
        out, s, nexts = [], 0, self.next
        for c in run:
            s = nexts[s][c]
            out.append(lengths[s])
        return out


def resolve(values: np.ndarray, bounds: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Flags of the windows that start twice, by the matching statistics of the shard's phrases."""
    flags = np.zeros(values.size, bool)
    _, symbols = np.unique(values, return_inverse=True)
    symbols, cuts = symbols.tolist(), bounds.tolist()
    runs = [symbols[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    automaton = SuffixAutomaton()
    for run, n in zip(runs, times.tolist(), strict=True):
        automaton.add(run, n)
    lengths = automaton.repeated_lengths()
    for run, a in zip(runs, cuts, strict=False):
        stats = np.array(automaton.matching_statistics(run, lengths))
        ends = np.flatnonzero(stats >= length)
        flags[a + ends - length + 1] = True
    return flags


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs; with_text adds the kept words, joined by a space."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(2)):
                n = hi - lo
                starts, ends, bounds = tx.word_spans(data, offsets)
                gone = windows.covered(b.column(3).slice(lo, n), bounds, length)
                doc = tx.per_document(bounds)
                # kept words, each with a space after it but for a document's last
                s, e, d = starts[~gone], ends[~gone], doc[~gone]
                size = e - s + 1
                last = np.ones(d.size, bool)
                last[:-1] = d[1:] != d[:-1]
                size[last] -= 1
                total = np.cumsum(size)
                flat = np.full(int(total[-1]) if total.size else 0, 32, np.uint8)
                at = np.arange(flat.size) - np.repeat(total - size, size)
                from_ = np.repeat(s, size) + at
                inside = at < np.repeat(e - s, size)
                flat[inside] = data[from_[inside]]
                cut = np.concatenate([[0], total])[np.searchsorted(d, np.arange(n + 1))].tolist()
                raw = flat.tobytes()
                kept = [raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
                out = [b.column(1).slice(lo, n), np.diff(bounds), tx.sums_by(doc[gone], n), [hashlib.sha256(x).hexdigest() for x in kept]]
                yield record_batch(schema, *out, *([pa.array(kept, pa.binary())] if with_text else []))

    return windows.apply_spans(docs, windows.word_symbols, resolve, length, trigger, "u8", run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)

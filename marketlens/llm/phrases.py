"""Phrases whose words keep company: exact counts by HAT-tries, then scores by the worst cut.

Words are counted first; then pairs of frequent words; then, in one pass, phrases of three and four words (the most) made
of frequent pairs, so few phrases are counted that can't be frequent. What is frequent comes to the tasks as a filter of
fixed size that leaves no frequent phrase out.

A task counts in a HAT-trie: the root branches by the first word's id, and below it hash containers count the packed ids
of the other words; a container that grows past ``BURST`` entries bursts into a node that branches by the next word. When
a task holds more than ``BUDGET`` entries it spills its largest subtrees whole, as a sorted run. Runs are tables; they are
merged in partitions of prefix ranges, so a frequent first word is spread over as many partitions as its phrases fill.

Everything is per language. Counts are exact; scores are exact decimals.

Defined cases: a null text is empty, a null lang is ``und`` (together with those that say so); repeated rows count each;
a null doc_id and other columns, of any name, are ignored; an empty table gives no rows; a very long text is a block of its
own; ties of score and count go to the smaller phrase by code point, and ties of cuts to the shorter first part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.tables import freed, in_filter, key_filter, modest_batches, record_batch, tidy, written

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A longer phrase that holds so many percent of a shorter one's occurrences replaces it.
NESTED_PERCENT = 80
SCALE = 2_000_000
#: Entries of a container that bursts, and of a task that spills; bits of a word's id in a task.
BURST, BUDGET, ID_BITS = 1 << 12, 1 << 20, 21
_BLOCK = 1 << 21
#: Phrases that a task gathers and sorts before they go to the trie together.
GATHER = 1 << 20
_RANK_SLICES = 64

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)

#: Bytes that end a piece, and those that end a word (fixed values).
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True


def _then(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return tx.mix(h * _STEP + word)


class PhraseTrie:
    """Counts of phrases of ``words`` words, given by their ids in this task."""

    def __init__(self, words: int, burst: int = BURST):
        self.words, self.burst = words, burst
        self.root: dict = {}
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Count phrases: rows of ids, in order, each once."""
        if self.words == 1:
            self._fill(self.root, ids[:, 0].tolist(), counts.tolist())
            return
        rest = ids[:, 1].astype(np.int64)
        for k in range(2, self.words):
            rest = rest << ID_BITS | ids[:, k]
        self._branch(self.root, ids[:, 0], rest, counts, self.words - 1)

    def _fill(self, container: dict, keys: list, counts: list) -> None:
        before, get = len(container), container.get
        if before:
            container.update([(k, get(k, 0) + n) for k, n in zip(keys, counts, strict=True)])
        else:
            container.update(zip(keys, counts, strict=True))
        self.size += len(container) - before

    def _branch(self, node: dict, heads: np.ndarray, rest: np.ndarray, counts: np.ndarray, left: int) -> None:
        """``node`` leads from a word to a container of the ``left`` words after it, or to (container's children,)."""
        lows = np.concatenate([[0], np.flatnonzero(np.diff(heads)) + 1])
        keys, values = rest.tolist(), counts.tolist()
        for head, lo, hi in zip(heads[lows].tolist(), lows.tolist(), [*lows[1:].tolist(), heads.size], strict=True):
            below = node.get(head)
            if below is None:
                below = node[head] = {}
            if isinstance(below, tuple):
                self._deeper(below[0], rest[lo:hi], counts[lo:hi], left)
                continue
            self._fill(below, keys[lo:hi], values[lo:hi])
            if left > 1 and len(below) > self.burst:
                burst = np.fromiter(below, np.int64, len(below))
                sums = np.fromiter(below.values(), np.int64, len(below))
                order = np.argsort(burst)
                node[head] = ({},)
                self.size -= len(below)
                self._deeper(node[head][0], burst[order], sums[order], left)

    def _deeper(self, node: dict, rest: np.ndarray, counts: np.ndarray, left: int) -> None:
        shift = ID_BITS * (left - 1)
        self._branch(node, rest >> shift, rest & ((1 << shift) - 1), counts, left - 1)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out subtrees, the largest first, until at most ``keep`` entries stay: ids and counts."""
        #: by the number of words before them: those words, and the containers
        stems, containers = [[] for _ in range(self.words)], [[] for _ in range(self.words)]

        def take(below, stem: tuple[int, ...]) -> None:
            if isinstance(below, tuple):
                for head, x in below[0].items():
                    take(x, (*stem, head))
                return
            stems[len(stem)].append(stem)
            containers[len(stem)].append(below)

        def entries(below) -> int:
            return sum(map(entries, below[0].values())) if isinstance(below, tuple) else len(below)

        if self.words == 1:
            if self.root:
                take(self.root, ())
            self.root, self.size = {}, 0
        else:
            for head, n in sorted(((h, entries(x)) for h, x in self.root.items()), key=lambda x: -x[1]):
                if self.size <= keep:
                    break
                take(self.root.pop(head), (head,))
                self.size -= n
        ids, counts = [np.zeros((0, self.words), np.int64)], [np.zeros(0, np.int64)]
        for depth, found in enumerate(containers):
            if not found:
                continue
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            rest = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
            part = np.empty((rest.size, self.words), np.int64)
            part[:, :depth] = np.repeat(np.array(stems[depth], np.int64).reshape(len(found), depth), sizes, axis=0)
            for k in range(depth, self.words):
                part[:, k] = rest >> (ID_BITS * (self.words - 1 - k)) & ((1 << ID_BITS) - 1)
            ids.append(part)
            counts.append(np.fromiter(chain.from_iterable(x.values() for x in found), np.int64, rest.size))
        return np.concatenate(ids), np.concatenate(counts)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ids, in order, and how often each is there."""
    words = ids.shape[1]
    if words <= 63 // ID_BITS:
        packed = ids[:, 0]
        for k in range(1, words):
            packed = packed << ID_BITS | ids[:, k]
        packed = np.sort(packed)
        firsts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        one = packed[firsts]
        rows = np.stack([one >> (ID_BITS * k) & ((1 << ID_BITS) - 1) for k in reversed(range(words))], axis=1)
    else:
        ids = ids[np.lexsort(ids.T[::-1])]
        firsts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        rows = ids[firsts]
    return rows, np.diff(np.append(firsts, ids.shape[0]))


class Words:
    """Ids of the words that a task has met, by the 64-bit hash of language and word."""

    def __init__(self):
        self.of: dict[int, int] = {}
        self.texts: list[str] = []
        self.langs: list[str] = []

    def ids(self, hashes: np.ndarray, texts, langs) -> np.ndarray:
        """Ids of different hashes; ``texts`` and ``langs`` give what is at a place, for those that are new."""
        out = np.fromiter(map(self.of.get, hashes.tolist(), repeat(-1)), np.int64, hashes.size)
        new = np.flatnonzero(out < 0)
        out[new] = np.arange(len(self.texts), len(self.texts) + new.size)
        self.of.update(zip(hashes[new].tolist(), out[new].tolist(), strict=True))
        self.texts += [texts(k) for k in new.tolist()]
        self.langs += [langs(k) for k in new.tolist()]
        return out


_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _run(words: Words, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A run of spilled phrases, sorted by language and words."""
    if not counts.size:
        return
    texts, langs = pa.array(words.texts, pa.string()), pa.array(words.langs, pa.string())
    rank = np.empty(len(texts), np.int64)
    rank[pc.sort_indices(pa.table({"lang": langs, "text": texts}), sort_keys=[("lang", "ascending"), ("text", "ascending")]).to_numpy()] = np.arange(len(texts))
    order = np.lexsort(rank[ids].T[::-1])
    for lo in range(0, order.size, 1 << 16):
        part = order[lo : lo + (1 << 16)]
        columns = [texts.take(pa.array(ids[part, k])) for k in range(ids.shape[1])]
        phrases = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[part, 0])), phrases, pa.array(counts[part])], schema=_RUN)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest())


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return tx.mix(tx.byte_prefix(data).spans(starts, ends) ^ salts)


def _hashes(table: DataFrame, words: int) -> DataFrame:
    """h, the hash of each of the table's phrases of so many words, as the tasks that count longer ones make it."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tx.column_bytes(b.column(1))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            starts, ends, _ = tx.word_spans(data, offsets, _ENDS_WORD)
            salts = {x: _salt(x) for x in set(b.column(0).to_pylist())}
            one = _word_hashes(data, starts, ends, np.repeat(np.array([salts[x] for x in b.column(0).to_pylist()], dtype=np.uint64), words)).reshape(-1, words)
            h = one[:, 0]
            for k in range(1, words):
                h = _then(h, one[:, k])
            yield record_batch(schema, tx.as_long(h))

    return table.select("lang", "phrase").mapInArrow(tidy(run), "h long")


def runs(docs: DataFrame, lengths: tuple[int, ...], shorter=None, budget: int | None = None, burst: int | None = None) -> DataFrame:
    """Sorted runs (lang, phrase, n) of the phrases of so many words (numbers in a row) whose parts of one word less than
    the first number are in the filter."""
    budget, burst = budget or BUDGET, burst or BURST
    least = lengths[0]
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, known, salts = [PhraseTrie(k, burst) for k in lengths], Words(), {}
        gathered: list[list[np.ndarray]] = [[] for _ in lengths]

        def counted(trie: PhraseTrie, waiting: list[np.ndarray]) -> None:
            if waiting:
                ids = np.concatenate(waiting)
                waiting.clear()
                trie.add(*_distinct(ids))

        def spilled(trie: PhraseTrie, keep: int) -> Iterator[pa.RecordBatch]:
            yield from _run(known, *trie.spill(keep))

        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, raw, offsets in tx.blocks(b.column(1), _BLOCK):
                data = tx.lower(raw)
                starts, ends, bounds = tx.word_spans(data, offsets, _ENDS_WORD)
                if starts.size < least:
                    continue
                doc = tx.per_document(bounds)
                for x in set(langs[lo:hi]) - salts.keys():
                    salts[x] = _salt(x)
                salt = np.array([salts[x] for x in langs[lo:hi]], dtype=np.uint64)
                one = _word_hashes(data, starts, ends, salt[doc])
                breaks = np.concatenate([[0], np.cumsum(_ENDS_PIECE[data])])
                linked = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
                # where phrases start, one word longer at each step; those of one word less than the first length are sifted
                h, ok, starts_of = one, np.ones(one.size, bool), []
                for k in range(1, lengths[-1]):
                    if k == least - 1:
                        ok &= in_filter(shorter.value, tx.as_long(h))
                    if k >= least:
                        starts_of.append(np.flatnonzero(ok))
                    ok = ok[:-1] & ok[1:] & linked[: max(0, ok.size - 1)]
                    if k < least - 1:
                        h = _then(h[:-1], one[k:])
                starts_of.append(np.flatnonzero(ok))
                used = np.zeros(one.size, bool)
                for k, at in zip(lengths, starts_of, strict=True):
                    for step in range(k):
                        used[at + step] = True
                spots = np.flatnonzero(used)
                if not spots.size:
                    continue
                keys, where, back = np.unique(one[spots], return_index=True, return_inverse=True)
                where, text = spots[where], data.tobytes()
                first, last = starts[where], ends[where]
                id_at = np.zeros(one.size, np.int64)
                id_at[spots] = known.ids(keys, lambda k: text[first[k] : last[k]].decode(), lambda k: langs[lo + doc[where[k]]])[back]
                full = len(known.texts) > min(budget, (1 << ID_BITS) - _BLOCK // 2)
                for k, at, trie, waiting in zip(lengths, starts_of, tries, gathered, strict=True):
                    if at.size:
                        waiting.append(id_at[at[:, None] + np.arange(k)])
                    if full or sum(map(len, waiting)) > min(budget, GATHER) // len(tries):
                        counted(trie, waiting)
                    if full or trie.size > budget // len(tries):
                        yield from spilled(trie, -1 if full else budget // len(tries) // 2)
                if full:
                    known = Words()
        for trie, waiting in zip(tries, gathered, strict=True):
            counted(trie, waiting)
            yield from spilled(trie, -1)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "lang string, phrase string, n long")


def merged(found: DataFrame, least: int) -> DataFrame:
    """Runs merged by ranges of prefixes: lang, phrase, n of the phrases with at least so many occurrences."""
    return found.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, **sizes) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words of each language, and the tables of frequent phrases of 1, 2, ... words."""
    if not 1 <= max_words <= 4:
        raise ValueError("the words after a phrase's first are packed in 64 bits, so phrases have at most four")
    words = written(runs(docs, (1,), **sizes), "word-runs", "zstd")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    tables = [written(merged(words, least), "phrases-1")]
    while len(tables) < max_words:
        k = len(tables) + 1
        lengths = (k,) if k == 2 or k == max_words else (k, k + 1)
        with freed(key_filter(_hashes(tables[-1], k - 1), "h")) as shorter:
            found = written(runs(docs, lengths, shorter, **sizes), f"phrase-runs-{k}", "zstd")
        table = written(merged(found, least), f"phrases-{k}")
        spaces = F.length("phrase") - F.length(F.translate("phrase", " ", ""))
        tables += [table.where(spaces == n - 1) for n in lengths]
    return totals, tables


def _exact(column) -> F.Column:
    return column.cast("decimal(20,0)")


def scores(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase of two words or more, by its worst cut."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.select("lang", "phrase", "n")
    longer = every.where(F.instr("phrase", " ") > 0).withColumn("words", F.split("phrase", " "))
    cut = longer.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumn("head", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("tail", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")).drop("words")
    # a frequent word heads or ends many phrases: these joins rely on the splitting of skewed partitions
    for side, out in (("head", "l"), ("tail", "r")):
        part = every.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(out))
        cut = cut.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part", side)
    cut = cut.withColumn("score", F.expr(f"CAST(CAST(a AS DECIMAL(20,0)) * {SCALE} AS DECIMAL(28,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long"))
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    return worst.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")


def nested(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, longest: occurrences of the most frequent longer phrase that holds it."""
    inside = None
    for k, table in enumerate(tables, 1):
        for m in range(2, k):
            w = F.split("phrase", " ")
            found = table.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: F.array_join(F.slice(w, i, m), " "))).alias("phrase"), F.col("n").alias("longest"))
            inside = found if inside is None else inside.unionByName(found)
    return inside.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP, percent: int = NESTED_PERCENT, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    totals, tables = frequent(docs, max_words, least, **sizes)
    scored = scores(tables)
    if max_words > 2:
        inside = nested(tables).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), "longest")
        held = _exact(F.col("longest")) * 100 >= _exact(F.col("a")) * percent
        scored = scored.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left").where(~F.coalesce(held, F.lit(False))).drop("_lang", "_part", "longest")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within slices, so that no task ranks a whole language
    sliced = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_SLICES)))
    sliced = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = sliced.drop("_slice", "_rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

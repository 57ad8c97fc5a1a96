"""Language identification: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word scores by its longest character n-grams that
are known: 5-grams if any of the word's is known, else 4-grams, down to single characters; the mean of their log
frequencies counts as the word. A text's languages are compared by the sum over its words, and the score is the
winner's share of the likelihood.

The model is fitted on a bounded sample of labelled documents: at most ``FIT_DOCUMENTS`` of each language, in hash
order, so that a rare language is not crowded out by a common one, and of each language's words and n-grams the most
frequent ``FIT_WORDS`` and ``FIT_GRAMS`` in all. Tasks count the sample's words and n-grams and Spark adds the counts
up; no text comes to the driver, and the model has a bounded size and is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing
to learn from, and an empty table gives no rows. A null doc_id is held out. Equal scores go to the language that sorts
first. Repeated rows are predicted each time, and learned from each time unless they are equal in doc_id, text and lang;
copies that differ in lang count for each. A very long text is a block of its own and is read whole. Other columns, of any
name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.tables import modest_batches, record_batch, tidy, written

FIT_DOCUMENTS = 3000
FIT_WORDS = 1 << 17
FIT_GRAMS = 1 << 15
GRAMS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_SMOOTH = 0.5


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text falls in the fold; a null doc_id does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def _points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def _grams(joined: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words that `_joined` gave, and the word of each."""
    points, word = joined
    if points.size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = tx.Prefix(tx.mix(points.astype(np.uint64) + np.uint64(1))).runs(n)
    ok = word[n - 1 :] == word[: word.size - n + 1]
    if n == 1:
        ok &= points != 32
    return keys[ok], word[: word.size - n + 1][ok]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ' word ' for each word, and the word's index of each point."""
    size = ends - starts + 2
    total = np.cumsum(size)
    flat = np.full(int(total[-1]) if size.size else 0, 32, np.uint8)
    owner = np.repeat(np.arange(size.size), size)
    at = np.arange(flat.size) - np.repeat(total - size, size)
    inside = (at > 0) & (at < size[owner] - 1)
    flat[inside] = data[(starts[owner] + at - 1)[inside]]
    first = (flat & 0xC0) != 0x80
    return _points(flat), owner[first]


@dataclass
class Table:
    """Sorted keys and, for each, the log frequency in each language."""

    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, times: np.ndarray, whole: np.ndarray, kinds: int) -> Table:
        """From counts of (key, language), the languages' totals and how many different keys there were."""
        seen, back = np.unique(keys, return_inverse=True)
        counts = np.zeros((seen.size, whole.size))
        np.add.at(counts, (back, langs), times)
        return cls(seen, np.log((counts + _SMOOTH) / (whole + _SMOOTH * (kinds + 1))).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        if not self.keys.size:
            return np.full(keys.size, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: dict[int, Table]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        raw = data
        data = tx.lower(data)
        letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        lettered = letters[offsets[1:]] > letters[offsets[:-1]]
        for k in np.flatnonzero(~lettered & (offsets[1:] > offsets[:-1])).tolist():
            lettered[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        starts, ends, bounds = tx.word_spans(data, offsets)
        doc = tx.per_document(bounds)
        keys, where, back = np.unique(tx.byte_prefix(data).spans(starts, ends), return_index=True, return_inverse=True)
        logs = np.zeros((keys.size, len(self.langs)))
        at = self.words.find(keys)
        logs[at >= 0] = self.words.logs[at[at >= 0]]
        open_ = np.flatnonzero(at < 0)
        s, e = starts[where[open_]], ends[where[open_]]
        for length in GRAMS:
            if not open_.size:
                break
            grams, word = _grams(_joined(data, s, e), length)
            rows = self.grams[length].find(grams)
            hit = rows >= 0
            count = np.bincount(word[hit], minlength=open_.size)
            done = count > 0
            for k in range(len(self.langs)):
                total = np.bincount(word[hit], weights=self.grams[length].logs[rows[hit], k], minlength=open_.size)
                logs[open_[done], k] = total[done] / count[done]
            open_, s, e = open_[~done], s[~done], e[~done]
        sums = np.stack([np.bincount(doc, weights=logs[back, k], minlength=n) for k in range(len(self.langs))], axis=1)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, share, 0.0)


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most so many different rows (doc_id, text, lang) of each language, the smallest by hash. Only hashes are ranked,
    after every task has kept the smallest of its own."""
    h = F.xxhash64("doc_id", "text")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64())])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            of, hashes = b.column(0), b.column(1).to_numpy()
            for lang in of.unique().to_pylist():
                own = hashes[pc.equal(of, lang).to_numpy(zero_copy_only=False)]
                held[lang] = np.unique(np.concatenate([held.get(lang, own[:0]), own]))[:most]
        for lang, kept in held.items():
            yield record_batch(schema, [lang] * kept.size, kept)

    rows = labelled.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("h", h)
    near = rows.select("lang", "h").mapInArrow(tidy(smallest), "lang string, h long").distinct()
    last = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most).groupBy("lang").agg(F.max("h").alias("last"))
    return rows.join(F.broadcast(last), "lang").where("h <= last").dropDuplicates(["doc_id", "text", "lang"])  # one row a language


def _counts(rows: DataFrame) -> DataFrame:
    """length (0 for words), lang, key and n of the sample's words and n-grams, added up by each task first."""
    schema = pa.schema([("length", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in b.column(1).unique().to_pylist():
                own = b.column(0).filter(pc.equal(b.column(1), lang))
                for _, _, data, offsets in tx.blocks(own):
                    data = tx.lower(data)
                    starts, ends, _ = tx.word_spans(data, offsets)
                    joined = _joined(data, starts, ends)
                    for length in (0, *GRAMS):
                        keys = _grams(joined, length)[0] if length else tx.byte_prefix(data).spans(starts, ends)
                        seen, times = np.unique(keys, return_counts=True)
                        yield record_batch(schema, np.full(seen.size, length, np.int32), [lang] * seen.size, tx.as_long(seen), times)

    each = rows.select("text", "lang").mapInArrow(tidy(run), "length int, lang string, key long, n long")
    return each.groupBy("length", "lang", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, max_documents: int = FIT_DOCUMENTS) -> Model:
    """A model from at most ``max_documents`` rows (doc_id, text, lang) of each language that have a text and a lang."""
    counts = written(_counts(_sample(labelled, max_documents)), "language-counts")
    keys = counts.groupBy("length", "key").agg(F.sum("n").alias("total"))
    totals = counts.groupBy("length", "lang").agg(F.sum("n").alias("n")).toArrow().to_pylist()  # a few rows a language
    kinds = {r["length"]: r["kinds"] for r in keys.groupBy("length").agg(F.count(F.lit(1)).alias("kinds")).collect()}
    langs = sorted({r["lang"] for r in totals})
    number = {x: k for k, x in enumerate(langs)}

    def table(length: int) -> Table:
        whole = np.zeros(len(langs))
        for r in totals:
            if r["length"] == length:
                whole[number[r["lang"]]] = r["n"]
        top = keys.where((F.col("length") == length) & (F.col("total") >= 2)).orderBy(F.desc("total"), "key").limit(FIT_GRAMS if length else FIT_WORDS)
        found = counts.where(F.col("length") == length).join(top.select("key"), "key").select("key", "lang", "n").toArrow()  # at most the bound, times the languages
        at = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
        return Table.of(found["key"].to_numpy().view(np.uint64), at, found["n"].to_numpy(), whole, kinds.get(length, 0))

    return Model(langs, table(0), {n: table(n) for n in GRAMS})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs; only the text is looked at."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                langs, score = shared.value.predict(data, offsets)
                yield record_batch(schema, b.column(0).slice(lo, hi - lo), langs, score)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, max_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the labelled documents outside the fold, applied to all."""
    model = fit(docs.where(~in_fold("doc_id", folds, fold)), max_documents)
    return predict(docs, model).select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")

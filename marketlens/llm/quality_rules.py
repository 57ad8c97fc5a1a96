"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit r is set when
rule r fails. A policy is a versioned mask: a document is kept when ``failed & mask = 0``, so other policies, and the
ablation of any rule, are bitwise arithmetic over the ledger and never touch the texts again.

Defined cases: a null or empty text has no words and fails the word-count rule; null doc_id and repeated rows are
passed through row by row; an empty table gives no rows; a very long text is measured whole, as a block of its own;
each row is judged alone, so there are no ties; other columns are ignored by the ledger and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import text as tx
from marketlens.llm.tables import modest_batches, record_batch, tidy

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is SQL over the measurements, in integers so that every engine agrees."""

    name: str
    fails: str


#: Bit r of the ledger is rule r.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_word_runs", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 15 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length_low", "word_chars < 2 * n_words"),
    Rule("word_length_high", "word_chars > 20 * n_words"),
)

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_word_runs"),
    "v1": ("few_words", "repeated_word_runs", "symbols"),
    "v2": ("few_words", "repeated_word_runs", "symbols", "duplicate_lines", "word_length_low", "word_length_high"),
}
POLICY = "v2"


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, bounds = tx.word_spans(data, offsets)
    doc = tx.per_document(bounds)
    words = np.diff(bounds)
    whole = tx.byte_prefix(data)

    # a code point has one byte that is no continuation byte
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = tx.sums_by(doc, n, first[ends] - first[starts])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])

    ls, le, ld = tx.line_spans(data, offsets)
    solid = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, ld = ls[solid], le[solid], ld[solid]
    key = whole.spans(ls, le)
    order = np.lexsort((key, ld))
    key, of = key[order], ld[order]
    again = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    dup_lines = tx.sums_by(of[1:][again], n)

    repeats = np.zeros(n, np.int64)
    if starts.size >= 3:
        grams = tx.Prefix(whole.spans(starts, ends)).runs(3)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        keys = tx.mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(at.size, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(starts.size, bool)
        for k in range(3):
            cover[at[twice] + k] = True
        repeats = tx.sums_by(doc[cover], n)
    return [words, chars, symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, repeats, tx.sums_by(ld, n)]


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements (long); n_lines counts the lines with a word."""
    modest_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                yield record_batch(schema, b.column(0)[lo:hi], *_measure(data, offsets))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_bits(rules=RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(names, rules=RULES) -> int:
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of the failed rules."""
    return measurements(docs).withColumn("failed", failure_bits())


def kept(policy: str = POLICY) -> Column:
    """Verdict of a policy over a ledger."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that the policy keeps without it."""
    names = POLICIES[policy]
    whole = mask(names)
    failed = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    aggs = []
    for name in names:
        bit = mask([name])
        aggs += [F.count_if(F.col("failed").bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{name}__fails"), F.count_if(failed == bit).alias(f"{name}__only"), F.count_if(failed.bitwiseAND(F.lit(whole & ~bit).cast("long")) == 0).alias(f"{name}__kept_without")]
    row = led.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), *[F.col(f"{name}__{k}").alias(k) for k in ("fails", "only", "kept_without")]) for name in names])).alias("r")).select("r.*")


def apply_rules(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """doc_id, the measurements, failed, base_failed and kept under the policy."""
    base = F.lit(mask(POLICIES["base"])).cast("long")
    return ledger(docs).withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0).withColumn("kept", ~F.col("base_failed") & kept(policy))


def filter_documents(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that the policy keeps, with all their columns, in one pass over the rows: measurements are appended
    to each row, so no join by id is needed and repeated rows or clashing column names do no harm."""
    modest_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"_c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(at)):
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *map(pa.array, _measure(data, offsets))], names=[*b.schema.names, *MEASURES])

    schema = T.StructType([*plain.schema.fields, *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return plain.mapInArrow(tidy(run), schema).withColumn("failed", failure_bits()).where(kept(policy)).select(*plain.columns).toDF(*names)

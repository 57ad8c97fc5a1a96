"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: by its number of words, then by its leading words; words with a digit are
variable and count as one wildcard. In a leaf, each word has so many lines that have it at its place. A line's middle word
(by that number, after the leading words) tells how many lines its template has; a word of much fewer lines is a
variable field and becomes a wildcard, too. A line whose other words make up most of it belongs to the template of these
words, and any other line is a template of its own. The rule compares a line's words with one another, so it holds for
frequent values of a field as for rare ones, at any size of the corpus, and where a leaf holds several templates.
Templates found in many documents are boilerplate: all their lines go but the first one (by doc_id and line), so that
one document keeps it.

Words are counted by leaf and place, lines by template, all by partial aggregates over all tasks, and lines meet their
templates in salted joins: neither a leaf with very many lines nor a line found in a third of all documents is one
task's burden, and no result depends on an order.

Defined cases: a null text stays null and has no lines; lines without a word are never counted nor dropped; repeated
rows (equal doc_id and text) count as one document; a null doc_id counts and comes first; a very long text is a block of
its own, and a very long line has as many places as it has words; an empty table gives no rows; other columns, of any
name, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import text as tx
from marketlens.llm.tables import freed, in_filter, key_filter, maybe_in, modest_batches, record_batch, tidy, written

#: Leading words that the tree looks at.
DEPTH = 3
#: Share of a line's places that must not be variable for it to belong to a template.
ALIKE = 0.8
#: A word is a variable field when its lines are less than this share of those of the line's middle word.
VARIABLE = 0.5
#: Documents from which on a template is boilerplate. A word of fewer lines can't be a fixed word of one.
MIN_DOCUMENTS = 10
#: Parts of a template's or a line's rows that meet it in different tasks.
SALTS = 16

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ANY = np.uint64(0x2A2A2A2A)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: document, number within the document, masked word hashes (all lines'), word bounds."""
    starts, ends, bounds = tx.word_spans(data, offsets)
    words = tx.byte_prefix(data).spans(starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    words[digits[ends] > digits[starts]] = _ANY
    ls, le, ld = tx.line_spans(data, offsets)
    number = np.arange(ls.size) - np.searchsorted(ld, ld)
    first, after = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    ok = after > first
    return ld[ok], number[ok], words, first[ok], after[ok]


def _keys(words: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and whole masked line of each line, as hashes."""
    prefix = tx.Prefix(words)
    size = (after - first).astype(np.uint64)
    salt = size * np.uint64(0x9E3779B97F4A7C15)
    return tx.mix(prefix.raw(first, np.minimum(after, first + DEPTH)) + salt), tx.mix(prefix.raw(first, after) + salt + np.uint64(1))


def _line_rows(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("leaf", pa.int64()), ("full", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(2)):
                doc, number, words, first, after = _lines(data, offsets)
                take = pa.array(doc)
                yield record_batch(schema, b.column(0).slice(lo, hi - lo).take(take), b.column(1).slice(lo, hi - lo).take(take), number.astype(np.int32), *map(tx.as_long, _keys(words, first, after)))

    return rows.mapInArrow(tidy(run), "rid long, doc_id long, line int, leaf long, full long")


def _line_words(rows: DataFrame, wanted) -> DataFrame:
    """full and its masked words, for lines whose hash may be among the wanted."""
    schema = pa.schema([("full", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in tx.blocks(b.column(2)):
                _, _, words, first, after = _lines(data, offsets)
                full = tx.as_long(_keys(words, first, after)[1])
                _, once = np.unique(full, return_index=True)
                once = once[in_filter(wanted.value, full[once])]
                raw = words.tobytes()
                yield record_batch(schema, full[once], pa.array([raw[8 * a : 8 * z] for a, z in zip(first[once].tolist(), after[once].tolist(), strict=True)], pa.binary()))

    return rows.mapInArrow(tidy(run), "full long, words binary")


def _places(words: DataFrame) -> DataFrame:
    """leaf, full, size, place and word of each word of each line, from rows of leaf, full, n and words."""
    schema = pa.schema([("leaf", pa.int64()), ("full", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = tx.column_bytes(b.column(3))
            size = np.diff(offsets) // 8
            of = np.repeat(np.arange(size.size), size)
            place = np.arange(of.size) - np.repeat(np.cumsum(size) - size, size)
            word = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64)
            at = pa.array(of)
            yield record_batch(schema, *(b.column(c).take(at) for c in range(3)), size[of].astype(np.int32), place.astype(np.int32), word)

    return words.select("leaf", "full", "n", "words").mapInArrow(tidy(run), "leaf long, full long, n long, size int, place int, word long")


def _templates(words: DataFrame, min_documents: int, alike: float = ALIKE) -> DataFrame:
    """full, template of the lines that belong to a template with a variable field, from rows of leaf, full, n and words."""
    places = _places(words)
    common = written(places.groupBy("leaf", "place", "word").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_documents), "common-words")
    # a line's common words, at most its length; words with a digit are wildcards and common as such
    held = places.join(common, ["leaf", "place", "word"]).groupBy("leaf", "full", "size").agg(F.collect_list(F.struct("place", "word", "lines")).alias("words"))
    held = held.where(F.size("words") >= alike * F.col("size"))
    after = F.array_sort(F.transform(F.filter("words", lambda w: w["place"] >= DEPTH), lambda w: w["lines"]))
    # the middle of all places after the leading ones; those that are not common count as 0. It is made a row's own
    # value before words are compared with it.
    rest = F.col("size") - DEPTH
    middle = F.transform(F.array(after), lambda a: F.coalesce(F.get(a, (F.floor(rest / 2) - (rest - F.size(a))).cast("int")), F.lit(0)))
    held = held.select("leaf", "full", "size", "words", F.explode(middle).alias("middle"))
    fixed = F.transform(F.filter("words", lambda w: (w["place"] < DEPTH) | (w["lines"] >= VARIABLE * F.col("middle"))), lambda w: F.struct(w["place"].alias("place"), w["word"].alias("word")))
    held = held.select("leaf", "full", "size", F.explode(F.array(fixed)).alias("fixed")).where((F.size("fixed") < F.col("size")) & (F.size("fixed") >= alike * F.col("size")))
    return held.select("full", F.xxhash64("leaf", F.array_sort("fixed")).alias("template"))


def _salted(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with the table's one row of their key, a key's rows in ``SALTS`` parts."""
    parted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rid", "line"), F.lit(SALTS)).cast("int")).join(parted, [key, "_salt"], how).drop("_salt")


def boilerplate(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """rid, line of the lines to drop, from rows of rid, doc_id, text."""
    lines = written(_line_rows(rows), "lines")
    kinds = written(lines.groupBy("leaf", "full").agg(F.count(F.lit(1)).alias("n")), "kinds")
    # only leaves with several different lines, and with enough of them to be boilerplate together
    crowd = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).where((F.col("k") > 1) & (F.col("m") >= min_documents))
    tree = written(kinds.join(crowd, "leaf").select("leaf", "full", "n"), "tree")
    with freed(key_filter(tree, "full")) as wanted:
        words = written(_line_words(rows, wanted).groupBy("full").agg(F.first("words").alias("words")).join(tree, "full").select("leaf", "full", "n", "words"), "tree-words")
    joined = written(_templates(words, min_documents), "templates")
    with freed(key_filter(joined, "full")) as generalised:
        own = maybe_in(lines, "full", generalised, keep=False).withColumn("template", F.col("full"))
        met = _salted(maybe_in(lines, "full", generalised), joined, "full", "left").withColumn("template", F.coalesce("template", "full"))
        names = ["rid", "doc_id", "line", "template"]
        found = written(own.select(*names).unionByName(met.select(*names)), "line-templates")
    common = found.groupBy("template", "rid").agg(F.min(F.struct("doc_id", "rid", "line")).alias("first")).groupBy("template").agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first")).where(F.col("documents") >= min_documents)
    common = written(common.select("template", F.col("first.rid").alias("r"), F.col("first.line").alias("l")), "common-templates")
    with freed(key_filter(common, "template")) as repeated:
        hit = _salted(maybe_in(found, "template", repeated), common, "template")
        return written(hit.where("not (rid = r and line = l)").select("rid", "line").distinct(), "boilerplate")


def drop_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with the boilerplate lines taken out of text, and _n_lines, _n_removed (lines with a word)."""
    modest_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"_c{k}" for k in range(len(names))])
    text, doc_id = F.col(f"_c{at}").cast("string"), F.col(f"_c{names.index('doc_id')}").cast("long")
    plain = plain.withColumn("rid", F.xxhash64(doc_id, text))
    gone = boilerplate(plain.select("rid", doc_id.alias("doc_id"), text.alias("text")), min_documents)
    flags = key_filter(gone, "rid")
    lists = gone.groupBy("rid").agg(F.collect_list("line").alias("_gone"))  # at most a document's lines
    met = maybe_in(plain, "rid", flags).join(lists.hint("shuffle_hash"), "rid", "left").select(*plain.columns, "_gone")
    solid = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    others = maybe_in(plain, "rid", flags, keep=False).withColumn("_n_lines", F.size(solid).cast("long")).withColumn("_n_removed", F.lit(0).cast("long")).drop("rid")
    fields = [f for f in plain.schema.fields if f.name != "rid"]
    schema = T.StructType([*fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            n_lines, removed = [], []
            for i, (t, g) in enumerate(zip(texts, gone, strict=True)):
                parts = t.split("\n") if t else []
                n_lines.append(sum(1 for p in parts if p.strip(" \t\n\v\f\r")))
                removed.append(len(g or ()))
                if g:
                    drop = set(g)
                    texts[i] = "\n".join(p for k, p in enumerate(parts) if k not in drop)
            columns = [pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())], names=[f.name for f in schema.fields])

    return met.drop("rid").mapInArrow(tidy(run), schema).unionByName(others).toDF(*names, "_n_lines", "_n_removed")


def filter_documents(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs without boilerplate lines; documents that had nothing else go."""
    return drop_lines(docs, min_documents).where("_n_removed = 0 or _n_removed < _n_lines").drop("_n_lines", "_n_removed")

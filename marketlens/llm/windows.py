"""Finding every window of L symbols that starts twice in the corpus, without listing all windows.

Symbols are bytes or words. Each window is assigned to one trigger: the place in it where a rolling hash of k symbols
is smallest. The choice depends on the window's content alone, so equal windows have equal triggers at equal offsets,
and the windows of one trigger are neighbours: together they span one phrase of at most 2 L - k symbols. Phrases
overlap by L - 1 symbols, so every window lies whole in exactly one phrase.

* Phrases are counted by (trigger hash, phrase hash). A phrase seen twice repeats all its windows; a trigger seen once
  repeats none. Only triggers with several different phrases need their symbols, once for each different phrase: this
  is the dictionary.
* The dictionary is dealt out by trigger, and a resolver finds the repeated windows of each phrase.
* A trigger with very many phrases is split by the text around it: of each phrase, the windows that start far before
  the trigger and those that start near it become two pieces. All windows of a piece share what lies between the latest
  start and the earliest end, and equal windows share it, too; so pieces are dealt out by that core, which is longer than
  the trigger. Equal pieces are one from here on, and pieces are split again until every core has few.

Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.tables import freed, in_filter, key_filter, maybe_in, modest_batches, record_batch, tidy, written

#: Different phrases of a trigger (pieces of a core) above which they are split; it changes no result.
CROWDED = 2000
#: Unit of the number of windows in a phrase's shape; places lie below it.
SHAPE = 1 << 16
#: Symbols of the dictionary that a resolver gets at a time (whole triggers).
RESOLVED = {"u1": 1 << 19, "u8": 1 << 15}

#: (symbols as uint64 in an order-preserving form, first symbol of each document) of a block.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = tx.word_spans(data, offsets)
    return tx.byte_prefix(data).spans(starts, ends), bounds


def prefix_of(symbols: np.ndarray) -> tx.Prefix:
    return tx.byte_prefix(symbols) if symbols.dtype == np.uint8 else tx.Prefix(symbols)


def phrases(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Document, first and last window start (within the document), trigger hash, phrase hash and place of the trigger
    (within the phrase) of each phrase."""
    n = symbols.size - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64), z
    prefix = prefix_of(symbols)
    grams = prefix.runs(k)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams.size, dtype=np.uint64)
    trigger = (tx.sliding_min(packed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = bounds[1:] - length  # last window start of each document
    size = np.maximum(0, last - bounds[:-1] + 1)
    doc = np.repeat(np.arange(len(size)), size)
    start = np.arange(doc.size) - np.repeat(np.cumsum(size) - size, size) + bounds[:-1][doc]
    at = trigger[start]
    new = np.ones(at.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], at.size)[: head.size] - 1
    lo, hi, of, place = start[head], start[tail], doc[head], at[head]
    phrase = tx.mix(prefix.spans(lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return of, lo - bounds[of], hi - bounds[of], grams[place], phrase, place - lo


def _rows(docs: DataFrame, symbols: Symbols, length: int, k: int) -> DataFrame:
    """rid, lo, shape (windows less one times SHAPE, plus the trigger's place), trigger and phrase of every phrase."""
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int32()), ("shape", pa.int32()), ("trigger", pa.int64()), ("phrase", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, after, data, offsets in tx.blocks(b.column(1)):
                of, lo, hi, trigger, phrase, place = phrases(*symbols(data, offsets), length, k)
                yield record_batch(schema, b.column(0).slice(first, after - first).take(pa.array(of)), lo.astype(np.int32), ((hi - lo) * SHAPE + place).astype(np.int32), tx.as_long(trigger), tx.as_long(phrase))

    return docs.select("rid", "text").mapInArrow(tidy(run), "rid long, lo int, shape int, trigger long, phrase long")


def _dictionary(docs: DataFrame, wanted: DataFrame, symbols: Symbols, length: int) -> DataFrame:
    """trigger, phrase, n, place and the symbols of the wanted phrases (rid, lo, shape, trigger, phrase, n), written."""
    places = wanted.groupBy("rid").agg(F.collect_list(F.struct("lo", "shape", "trigger", "phrase", "n")).alias("p"))  # at most a document's phrases
    schema = pa.schema([("trigger", pa.int64()), ("phrase", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, after, data, offsets in tx.blocks(b.column(0)):
                p = b.column(1).slice(first, after - first)
                flat = p.flatten()
                of = np.repeat(np.arange(after - first), np.diff(p.offsets.to_numpy()))
                values, bounds = symbols(data, offsets)
                raw, width = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
                lo = flat.field("lo").to_numpy() + bounds[of]
                shape = flat.field("shape").to_numpy()
                hi = lo + shape // SHAPE + length
                cut = [bytes(raw[a:z]) for a, z in zip((lo * width).tolist(), (hi * width).tolist(), strict=True)]
                yield record_batch(schema, flat.field("trigger"), flat.field("phrase"), flat.field("n"), shape % SHAPE, pa.array(cut, pa.binary()))

    with freed(key_filter(wanted, "rid")) as near:
        joined = maybe_in(docs.select("rid", "text"), "rid", near).dropDuplicates(["rid"]).join(places.hint("shuffle_hash"), "rid").select("text", "p")
        return written(joined.mapInArrow(tidy(run), "trigger long, phrase long, n long, place int, symbols binary"), "dictionary")


#: (symbols of all phrases one after another, phrase bounds, times each phrase comes, L) to a flag for each symbol that
#: starts a window which starts twice.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _ranges(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, first and last flagged symbol (within the phrase) of each run of flags."""
    on = np.flatnonzero(flags)
    if not on.size:
        return on, on, on
    of = np.searchsorted(bounds, on, side="right") - 1
    new = np.ones(on.size, bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], on.size) - 1
    return of[head], on[head] - bounds[of[head]], on[tail] - bounds[of[head]]


def _resolved(dictionary: DataFrame, resolver: Resolver, length: int, dtype: str) -> DataFrame:
    """trigger, phrase, from, to (offsets within the phrase): runs of repeated windows, for whole triggers in a task."""
    schema = pa.schema([("trigger", pa.int64()), ("phrase", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = tx.column_bytes(rows["symbols"].cast(pa.large_binary()))
        values = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype)
        bounds = (offsets - offsets[0]) // np.dtype(dtype).itemsize
        of, first, last = _ranges(resolver(values, bounds, rows["n"].to_numpy(), length), bounds)
        at = pa.array(of)
        return record_batch(schema, rows["trigger"].combine_chunks().take(at), rows["phrase"].combine_chunks().take(at), first.astype(np.int32), last.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.column(3).nbytes for x in held) < RESOLVED[dtype] * np.dtype(dtype).itemsize:
                continue
            rows = pa.Table.from_batches(held)
            t = rows["trigger"].to_numpy()
            cut = int(np.flatnonzero(t != t[-1])[-1]) + 1 if (t != t[-1]).any() else 0  # the last trigger may go on
            # whole triggers, a part at a time
            ends = np.append(np.flatnonzero(t[1:cut] != t[: cut - 1]) + 1, cut) if cut else np.zeros(0, int)
            size = np.cumsum([0, *map(len, rows["symbols"].to_pylist())])
            lo = 0
            for z in ends.tolist():
                if size[z] - size[lo] >= RESOLVED[dtype] * np.dtype(dtype).itemsize or z == cut:
                    yield settle(rows.slice(lo, z - lo))
                    lo = z
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    # much work on few bytes: as many tasks as there are shuffle partitions, which the planner does not merge
    tasks = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dictionary.repartition(tasks, "trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(tidy(run), "trigger long, phrase long, from int, to int")


def _pieces(dictionary: DataFrame, length: int, dtype: str) -> DataFrame:
    """Rows of trigger, phrase, n, place, a, b and symbols, of which the windows start a to b - 1 symbols before the
    trigger, as two pieces each: trigger, phrase, at (where the piece starts), core, piece, and its own n, place, a, b and
    symbols. A piece without windows is left out."""
    width = np.dtype(dtype).itemsize
    schema = pa.schema([("trigger", pa.int64()), ("phrase", pa.int64()), ("at", pa.int32()), ("core", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for r in batch.to_pylist():
                values = np.frombuffer(r["symbols"], dtype)
                prefix, place, last = prefix_of(values), r["place"], values.size - length
                middle = (r["a"] + r["b"]) // 2
                for a, b in ((r["a"], middle), (middle, r["b"])):
                    first, after = max(0, place - b + 1), min(last, place - a) + 1  # starts of the piece's windows
                    if first >= after:
                        continue
                    place_in = np.uint64((place - first) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    core = prefix.spans(np.array([place - a]), np.array([place - b + 1 + length]))
                    core = tx.mix(core ^ np.array([r["trigger"]], np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(a * 65537 + b))
                    whole = tx.mix(prefix.spans(np.array([first]), np.array([after - 1 + length])) + place_in)
                    row = (r["trigger"], r["phrase"], first, int(core.view(np.int64)[0]), int(whole.view(np.int64)[0]), r["n"], place - first, a, b, r["symbols"][first * width : (after - 1 + length) * width])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield record_batch(schema, *out)

    return dictionary.select("trigger", "phrase", "n", "place", "a", "b", "symbols").mapInArrow(tidy(run), "trigger long, phrase long, at int, core long, piece long, n long, place int, a int, b int, symbols binary")


def _settled(dictionary: DataFrame, resolver: Resolver, length: int, dtype: str, crowded: int) -> DataFrame:
    """trigger, phrase, from, to: runs of repeated windows, of rows of trigger, phrase, n, place, a, b, symbols and kinds
    (the trigger's different phrases), each (trigger, phrase) once."""
    small = _resolved(dictionary.where(F.col("kinds") <= crowded).select("trigger", "phrase", "n", "symbols"), resolver, length, dtype)
    large = dictionary.where(F.col("kinds") > crowded)
    if large.isEmpty():
        return small
    pieces = written(_pieces(large, length, dtype), "pieces")
    counted = pieces.groupBy("core", "piece").agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("symbols").alias("symbols"))
    kinds = pieces.select("core", "piece").distinct().groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    counted = written(counted.withColumnsRenamed({"core": "trigger", "piece": "phrase"}), "counted-pieces")
    deeper = written(counted.join(kinds.withColumnRenamed("core", "trigger"), "trigger"), "deeper")
    # a piece that comes twice repeats whole; the parts of the others are found a level below
    twice = counted.where("n > 1").select("trigger", "phrase", F.lit(0).alias("from"), (F.octet_length("symbols") / np.dtype(dtype).itemsize - length).cast("int").alias("to"))
    found = twice.unionByName(_settled(deeper, resolver, length, dtype, crowded).join(twice.select("trigger", "phrase"), ["trigger", "phrase"], "left_anti"))
    found = found.withColumnsRenamed({"trigger": "core", "phrase": "piece"})
    up = pieces.select("trigger", "phrase", "at", "core", "piece").join(found, ["core", "piece"])
    return small.unionByName(up.select("trigger", "phrase", (F.col("at") + F.col("from")).cast("int").alias("from"), (F.col("at") + F.col("to")).cast("int").alias("to")))


def repeated(docs: DataFrame, symbols: Symbols, resolver: Resolver, length: int, k: int, dtype: str) -> DataFrame:
    """rid and spans (array of first and last start) of the windows of ``length`` symbols that start twice or more.

    docs has rid (a hash of the row's identity) and text; rows with the same rid must be equal. length is below 32,768.
    """
    found = written(_rows(docs, symbols, length, k), "phrases")
    counted = found.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "lo", "shape")).alias("p"))
    counted = written(counted.select("trigger", "phrase", "n", "p.*"), "counted")
    kinds = counted.groupBy("trigger").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    dictionary = _dictionary(docs, counted.join(kinds, "trigger").select("rid", "lo", "shape", "trigger", "phrase", "n"), symbols, length)
    dictionary = dictionary.join(kinds, "trigger").withColumns({"a": F.lit(0), "b": F.lit(length - k + 1)})
    parts = _settled(dictionary, resolver, length, dtype, CROWDED)
    # a phrase that comes twice repeats whole; the parts of the others are what the resolver found
    parts = parts.groupBy("trigger", "phrase").agg(F.collect_list(F.struct("from", "to")).alias("parts"))
    whole = counted.where("n > 1").select("trigger", "phrase", F.lit(None).cast("array<struct<from:int,to:int>>").alias("parts"))
    some = parts.join(counted.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"], "left_anti")
    hits = found.join(whole.unionByName(some), ["trigger", "phrase"])
    spans = F.when(F.col("parts").isNull(), F.array(F.struct(F.col("lo").alias("from"), (F.col("lo") + F.shiftright("shape", 16)).alias("to")))).otherwise(F.transform("parts", lambda x: F.struct((F.col("lo") + x["from"]).alias("from"), (F.col("lo") + x["to"]).alias("to"))))
    return hits.select("rid", spans.alias("s")).groupBy("rid").agg(F.flatten(F.collect_list("s")).alias("spans"))  # at most a document's windows


def covered(spans: pa.Array, bounds: np.ndarray, length: int) -> np.ndarray:
    """Flag of each symbol covered by a window that starts in its document's spans (null: none)."""
    if isinstance(spans, pa.ChunkedArray):
        spans = spans.combine_chunks()
    n = int(bounds[-1])
    delta = np.zeros(n + 1, np.int64)
    flat = spans.flatten()
    if len(flat):
        size = np.asarray(spans.value_lengths().fill_null(0))
        of = np.repeat(np.arange(len(spans)), size)
        np.add.at(delta, flat.field("from").to_numpy() + bounds[of], 1)
        np.add.at(delta, flat.field("to").to_numpy() + length + bounds[of], -1)
    return np.cumsum(delta[:-1]) > 0


def apply_spans(docs: DataFrame, symbols: Symbols, resolver: Resolver, length: int, k: int, dtype: str, run, schema: str) -> DataFrame:
    """run, a function over Arrow batches of rid, doc_id, text and spans (null where nothing repeats), on every row of
    docs (doc_id, text)."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    spans = written(repeated(rows, symbols, resolver, length, k, dtype), "spans")
    flags = key_filter(spans, "rid")
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.filter(pa.array(~in_filter(flags.value, b.column(0).to_numpy())))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, kind)], names=["rid", "doc_id", "text", "spans"])

    # only rows that may have spans are shuffled to meet them
    met = maybe_in(rows, "rid", flags).join(spans.hint("shuffle_hash"), "rid", "left").select("rid", "doc_id", "text", "spans")
    return met.mapInArrow(tidy(run), schema).unionByName(rows.mapInArrow(tidy(lambda batches: run(others(batches))), schema))

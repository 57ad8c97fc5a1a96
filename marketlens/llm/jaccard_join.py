"""Joining documents by the Jaccard similarity of their word shingles, with rare-first prefix filtering.

1. One pass takes each document's set of distinct 5-word shingles: its size, a hash of the whole set and a histogram of
   hash parts. Documents with equal sets are one class from here on.
2. Shingles are ordered rare first (by a fixed-size table of counts over all documents, ties by hash); two sets that
   are similar enough must share one of their first ``n - ceil(t n) + 1``. Classes meet in the lists of these shingles.
3. Pivots: a list of two is a pair. In every longer list all members are compared with the most central one, the one
   with the largest share of its prefix in such lists. Copies of one text with edits are nearest to the least edited of
   them, so this links the bulk of a group of near copies with comparisons that are linear in the group.
4. The exact join of what is still apart: lists whose members lie in several components are dealt out in blocks of
   members, and each task compares a pair of blocks. Pairs of different components that pass the length, positional
   and suffix filters are verified once each on their texts.
5. Components of the links, by star contraction.

The suffix filter compares histograms: the sets differ in at least as many shingles as their histograms do, and a pair
that differs in more than the similarity allows is dropped without reading its texts.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own component; a
null doc_id takes part and never is a component's smallest id unless no other is; repeated rows are one class; a very
long text is a block of its own and is compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.graphs import components
from marketlens.llm.tables import freed, in_filter, key_filter, maybe_in, modest_batches, record_batch, tidy, written

WORDS = 5
PERCENT = 75
#: Parts of the suffix filter's histogram.
PARTS = 64
#: Counters of the table that orders shingles: 8 MB, whatever the corpus.
COUNTERS = 1 << 20
#: A shingle whose counter is so far above the mean is dealt out by salt.
HOT, SALTS = 5000, 64
#: Members of a block of a list, about.
BLOCK = 256
#: Candidate pairs whose histograms a task compares at a time.
COMPARED = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a block, and the first of each document (n + 1 values); by hash, or
    rare first by the counts."""
    n = len(offsets) - 1
    data = tx.lower(data)
    starts, ends, bounds = tx.word_spans(data, offsets)
    words = tx.byte_prefix(data).spans(starts, ends)
    prefix = tx.Prefix(words)
    grams = prefix.runs(k)
    size = np.diff(bounds)
    doc = tx.per_document(bounds)
    whole = doc[: grams.size] == doc[k - 1 :] if grams.size else np.zeros(0, bool)
    short = np.flatnonzero((size > 0) & (size < k))
    h = np.concatenate([grams[whole], prefix.spans(bounds[:-1][short], bounds[1:][short])])
    of = np.concatenate([doc[: grams.size][whole], short]).astype(np.uint64)
    key = of << np.uint64(32)
    if counts is not None:
        key |= np.minimum(counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], 0x7FFFFFFF).astype(np.uint64)
    order = np.lexsort((h, key))
    h, of = h[order], of[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new].astype(np.int64)
    return h, np.searchsorted(of, np.arange(n + 1))


def _signatures(rows: DataFrame, k: int) -> DataFrame:
    """rid, doc_id, n, cls (hash of the set) and parts (its histogram)."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("parts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(2)):
                n = hi - lo
                h, bounds = shingle_sets(data, offsets, k)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(n), size)
                total = np.concatenate([[0], np.cumsum(tx.mix(h ^ np.uint64(0xA5A5)), dtype=np.uint64)]).astype(np.uint64)
                cls = tx.mix((total[bounds[1:]] - total[bounds[:-1]]) + size.astype(np.uint64))
                parts = np.bincount(doc * PARTS + ((h >> np.uint64(20)) & np.uint64(PARTS - 1)).astype(np.int64), minlength=n * PARTS).reshape(n, PARTS)
                parts = np.minimum(parts, 65535).astype("<u2")
                yield record_batch(schema, b.column(0).slice(lo, n), b.column(1).slice(lo, n), size.astype(np.int32), tx.as_long(cls), pa.array([x.tobytes() for x in parts], pa.binary()))

    return rows.mapInArrow(tidy(run), "rid long, doc_id long, n int, cls long, parts binary")


def _counts(rows: DataFrame, k: int) -> np.ndarray:
    """How many documents hold a shingle of each counter: 2**20 counters, added up in chunks."""
    chunk = 1 << 14
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, _, data, offsets in tx.blocks(b.column(0)):
                h, _ = shingle_sets(data, offsets, k)
                whole += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        for c in np.flatnonzero(whole.reshape(-1, chunk).any(axis=1)).tolist():
            yield record_batch(schema, [c], pa.array([whole[c * chunk : (c + 1) * chunk]], pa.list_(pa.int64())))

    def add(table: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in table["counts"].combine_chunks())
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([total], pa.list_(pa.int64()))})

    out = np.zeros(COUNTERS, np.int64)
    parts = rows.select("text").mapInArrow(tidy(run), "chunk int, counts array<long>").groupBy("chunk").applyInArrow(add, "chunk int, counts array<long>")
    found = parts.toArrow().combine_chunks()  # as large as the counters, in one job
    for c, counts in zip(found["chunk"].to_pylist(), found["counts"].combine_chunks() if len(found) else [], strict=True):
        out[c * chunk : (c + 1) * chunk] = counts.values.to_numpy()
    return out


def prefix_size(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def _prefixes(rows: DataFrame, near, k: int, percent: int, counts, only=None) -> DataFrame:
    """h, rid, salt of the rare-first prefix of the set of every row whose rid may be in the filter near; salt is 0 but
    for hot shingles. With a filter of wanted shingles (only): h, rid, n, pos and share, the share in thousandths of the
    prefix that is wanted."""
    mean = counts.value.mean()
    full = only is not None
    fields = [("h", pa.int64()), ("rid", pa.int64())]
    schema = pa.schema([*fields, ("n", pa.int32()), ("pos", pa.int32()), ("share", pa.int32())] if full else [*fields, ("salt", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.filter(pa.array(in_filter(near.value, b.column(0).to_numpy())))
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                h, bounds = shingle_sets(data, offsets, k, counts.value)
                size = np.diff(bounds)
                take = np.where(size > 0, prefix_size(size, percent), 0)
                of = np.repeat(np.arange(hi - lo), take)
                pos = np.arange(of.size) - np.repeat(np.cumsum(take) - take, take)
                h = h[bounds[:-1][of] + pos]
                rid = b.column(0).slice(lo, hi - lo).to_numpy()
                if not full:
                    hot = counts.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)] > mean + HOT
                    yield record_batch(schema, tx.as_long(h), rid[of], np.where(hot, (rid[of] & (SALTS - 1)) + 1, 0).astype(np.int16))
                    continue
                keep = in_filter(only.value, tx.as_long(h))
                h, of, pos = h[keep], of[keep], pos[keep]
                share = 1000 * np.bincount(of, minlength=hi - lo) // np.maximum(1, take)
                yield record_batch(schema, tx.as_long(h), rid[of], size[of].astype(np.int32), pos.astype(np.int32), share[of].astype(np.int32))

    return rows.select("rid", "text").mapInArrow(tidy(run), "h long, rid long, " + ("n int, pos int, share int" if full else "salt short"))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common)


def _verified(rows: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b of rids) whose texts' sets are similar enough, as a written table. Texts of b are dealt to their
    a; an a with many partners is split by salt, and its text goes to each part."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / 256)))
    roles = salted.select(F.col("b").alias("rid"), "a", "salt", F.lit(1).alias("partner"))
    roles = roles.unionByName(salted.select(F.col("a").alias("rid"), "a", "salt", F.lit(0).alias("partner")).distinct())
    roles = written(roles, "roles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, of = np.zeros(0, np.uint64), None
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(4)):
                h, bounds = shingle_sets(data, offsets, k)
                a, partner, rid = (b.column(c).slice(lo, hi - lo).to_numpy() for c in (0, 2, 3))
                out_a, out_b = [], []
                for i in range(hi - lo):
                    own = h[bounds[i] : bounds[i + 1]]
                    if not partner[i]:
                        pivot, of = own.copy(), a[i]
                    elif of == a[i] and similar(pivot, own, percent):
                        out_a.append(a[i])
                        out_b.append(rid[i])
                yield record_batch(schema, pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()))

    with freed(key_filter(roles, "rid")) as near:
        texts = maybe_in(rows.select("rid", "text"), "rid", near).dropDuplicates(["rid"])
        dealt = texts.join(roles.hint("shuffle_hash"), "rid").repartition("a", "salt").sortWithinPartitions("a", "salt", "partner").select("a", "salt", "partner", "rid", "text")
        return written(dealt.mapInArrow(tidy(run), "a long, b long"), "links")


def _pivots(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): every member of a list (h, rid, n, pos, share) with the list's most central one, where lengths and
    places allow, each once."""
    best = F.max(F.struct("share", (-F.col("rid")).alias("r"), F.col("rid").alias("a"), F.col("n").alias("n1"), F.col("pos").alias("i")))
    top = lists.groupBy("h").agg(best.alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "p.a", "p.n1", "p.i")
    need = F.ceil((F.col("n") + F.col("n1")) * percent / (100 + percent) - 1e-9)
    near = (F.least("n", "n1") * 100 >= F.greatest("n", "n1") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("n1") - F.col("i")) >= need)
    return lists.join(top, "h").where("rid <> a").where(near).select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b")).distinct()


def _suffix_near(p1: np.ndarray, p2: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether histograms differ by no more than sets of the similarity, of n shingles together, may."""
    # 100 I >= percent (n - I) bounds the difference n - 2 I
    return np.abs(p1 - p2).sum(axis=1) <= n - 2 * -(-percent * n // (100 + percent))


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose lengths and histograms differ by no more than the similarity allows."""
    one = classes.select(F.col("rid").alias("a"), F.col("n").alias("n1"), F.col("parts").alias("p1"))
    two = classes.select(F.col("rid").alias("b"), F.col("n").alias("n2"), F.col("parts").alias("p2"))
    joined = pairs.join(one, "a").join(two, "b").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p1, p2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, PARTS).astype(np.int32) for c in (2, 4))
                keep = pa.array(_suffix_near(p1, p2, b.column(1).to_numpy().astype(np.int64) + b.column(3).to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(5).filter(keep)], schema=schema)

    return joined.select("a", "n1", "p1", "n2", "p2", "b").mapInArrow(tidy(run), "a long, b long")


def _apart(members: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, from members of lists (h, rid, n, pos, component) and
    their histograms in classes. Each list is cut into blocks of members by hash, and every pair of blocks is one
    comparison."""
    sizes = members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    cut = members.join(sizes.where("c1 <> c2").select("h", "blocks"), "h").join(classes.select("rid", "parts"), "rid").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "n", "pos", "component", "parts")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        h, i, j, own, rid, n, pos, component = (rows[c].to_numpy() for c in ("h", "i", "j", "own", "rid", "n", "pos", "component"))
        parts = np.frombuffer(b"".join(rows["parts"].to_pylist()), "<u2").reshape(-1, PARTS).astype(np.int32)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.cumsum(new)
        a, b = [], []
        for step in range(1, int(np.bincount(group).max())):
            x = np.flatnonzero(group[step:] == group[:-step])  # pairs so far apart in one comparison
            y = x + step
            both = n[x] + n[y]
            need = -(-percent * both // (100 + percent))
            ok = (component[x] != component[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            ok &= np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            x, y, both = x[ok], y[ok], both[ok]
            for lo in range(0, x.size, COMPARED):
                u, v = x[lo : lo + COMPARED], y[lo : lo + COMPARED]
                keep = _suffix_near(parts[u], parts[v], both[lo : lo + COMPARED], percent)
                a.append(np.minimum(rid[u[keep]], rid[v[keep]]))
                b.append(np.maximum(rid[u[keep]], rid[v[keep]]))
        none = np.zeros(0, np.int64)
        return record_batch(schema, np.concatenate([none, *a]), np.concatenate([none, *b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            keys = [rows[c].to_numpy() for c in ("h", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in keys]))  # the last comparison may go on
            cut = int(last[-1]) + 1 if last.size else 0
            if cut:
                yield compare(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return cut.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(tidy(run), "a long, b long").distinct()


def _linked(docs: DataFrame, k: int, percent: int, block: int | None = None) -> DataFrame:
    """rid, doc_id, n, cls and component (null for empty sets) of every row of docs."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    sig = written(_signatures(rows, k), "signatures")
    # one row a class: its smallest rid stands for it
    classes = written(sig.where("n > 0").groupBy("cls").agg(F.min(F.struct("rid", "n", "parts")).alias("c")).select("cls", "c.*"), "classes")

    # lists of the prefix shingles that several classes hold: a list of two is a pair, of longer ones the members are wanted
    with freed(rows.sparkSession.sparkContext.broadcast(_counts(rows, k))) as counts, freed(key_filter(classes, "rid")) as near:
        held = _prefixes(rows, near, k, percent, counts).repartition("h", "salt").groupBy("h", "salt").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("a"), F.max("rid").alias("b"))
        held = held.where("m > 1 or salt > 0").groupBy("h").agg(F.sum("m").alias("m"), F.min("a").alias("a"), F.max("b").alias("b"))
        held = written(held.where("m > 1 and a <> b"), "held")
        with freed(key_filter(held.where("m > 2"), "h")) as only:
            lists = written(_prefixes(rows, near, k, percent, counts, only), "lists")

    # pairs and pivots, then the exact join of what they left apart
    pairs = held.where("m = 2").select("a", "b").distinct().unionByName(_pivots(lists, percent))
    stars = components(_verified(rows, written(_suffix_filter(pairs, classes, percent), "pairs"), k, percent))
    members = lists.join(stars.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    members = written(members.select("h", "rid", "n", "pos", "component"), "members")
    more = _verified(rows, written(_apart(members, classes, percent, block or BLOCK), "candidates"), k, percent)
    if not more.isEmpty():
        stars = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    joined = classes.select("rid", "cls").join(stars.withColumnRenamed("node", "rid"), "rid", "left").select("cls", F.coalesce("component", "rid").alias("component"))
    return written(sig.select("rid", "doc_id", "n", "cls").join(joined, "cls", "left"), "components")


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of every row of docs (doc_id, text)."""
    joined = _linked(docs, k, percent).withColumn("component", F.when(F.col("n") > 0, F.col("component")))
    least = joined.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = joined.join(least, "component", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, but only the first (by doc_id, then hash) of each component; rows that link with nothing stay."""
    names = docs.columns
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), doc_id.alias("_doc"), F.xxhash64(doc_id, text).alias("_rid"))
    joined = _linked(docs, k, percent)
    first = joined.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c"))).alias("f"))
    stay = first.select(F.col("f.c").alias("_rid")).unionByName(joined.where("n = 0").select(F.col("rid").alias("_rid")).distinct())
    # rows that are equal in doc_id and text share a rid: one of them stays
    kept = row.join(stay.distinct(), "_rid", "left_semi")
    return kept.groupBy("_rid").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")

"""Packing documents into sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence. The linear program over the length histogram (at
most ``capacity`` rows, whatever the corpus) asks for the fewest configurations that cover all pieces. It is solved by
multiplicative weights: lengths carry weights, a knapsack dynamic program finds the configuration of the largest weight,
and lengths that it covers lose weight. The fractional counts are rounded down, and what remains is filled by the same
weights, then by best fit over the histogram. The plan is a table of slots by length and rank; pieces are ranked
within their length in slices, and looked up.

Defined cases: a null or empty text is one id (the end id 0) and so one piece; repeated rows are packed as often as
they come, and so are rows with a null doc_id; a very long text is cut into as many full pieces as it has, and a rest;
pieces of one length are told apart by hash, doc_id and piece, and equal ones may change places; an empty table gives no
rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.subwords import Encoder
from marketlens.llm.tables import SLICES, hash_slice, modest_batches, record_batch, running_sums, tidy, written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Rounds and step of the multiplicative weights; shares of the fractional solution that are tried as the part to keep.
ROUNDS, STEP = 300, 8.0
KEPT_SHARES = (1.0, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2)

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids with the end id, cut where longer than the capacity."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                ids, bounds = encoder.ids(data, offsets)
                n = hi - lo
                # room for the end id of each document
                whole = np.zeros(ids.size + n, dtype="<u4")
                at = np.arange(ids.size) + np.repeat(np.arange(n), np.diff(bounds))
                whole[at] = ids
                begin = bounds[:-1] + np.arange(n)
                size = np.diff(bounds) + 1
                whole[begin + size - 1] = END_ID
                count = -(-size // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, first = memoryview(whole).cast("B"), (begin[doc] + start) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(first.tolist(), (first + length * 4).tolist(), strict=True)]
                yield record_batch(_PIECES, b.column(0).slice(lo, n).take(pa.array(doc)), piece, start, length, crc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_configuration(weights: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Lengths (with repeats) of the heaviest configuration by an unbounded knapsack, then held to what is left."""
    lengths = np.flatnonzero(weights > 0)
    value = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    w = weights[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if not k:
            continue
        got = value[c - lengths[:k]] + w[:k]
        best = int(got.argmax())
        value[c], pick[c] = got[best], lengths[best]
        if value[c - 1] > value[c]:
            value[c], pick[c] = value[c - 1], 0
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(pick[c])
            c -= pick[c]
        else:
            c -= 1
    out = np.bincount(out, minlength=capacity + 1)
    return np.minimum(out, left)


def _fill(config: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Add the longest remaining lengths that still fit."""
    config = config.copy()
    room = capacity - int(np.dot(config, np.arange(capacity + 1)))
    for length in np.flatnonzero(left > config)[::-1].tolist():
        if length <= room:
            k = min(room // length, int(left[length] - config[length]))
            config[length] += k
            room -= k * length
    return config


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations (length to count) and how often each is used, covering the histogram exactly."""
    need = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        need[length] = n
    out: list[tuple[np.ndarray, int]] = []
    if need[capacity]:  # full pieces fill a sequence each
        full = np.zeros_like(need)
        full[capacity] = 1
        out.append((full, int(need[capacity])))
        need[capacity] = 0
    sizes = np.arange(capacity + 1)
    bound = float(np.dot(need, sizes)) / capacity  # sequences of the fractional optimum, at least
    found: dict[bytes, list] = {}
    if bound:
        # long pieces are the hard ones: of equally full configurations those with longer pieces weigh more
        base = np.where(need > 0, sizes / capacity * (1 + 0.2 * sizes / capacity), 0.0)
        covered = np.zeros(capacity + 1)
        weights = base
        rounds = int(min(rounds, max(8, bound)))
        for _ in range(rounds):
            config = _best_configuration(weights, need, capacity)
            if not config.any():
                break
            found.setdefault(config.tobytes(), [config, 0])[1] += 1
            covered += np.minimum(config * (bound / rounds), need)
            # a length that is ahead of its share loses weight, one that is behind gains
            ahead = np.divide(covered, need, out=np.zeros_like(covered), where=need > 0)
            mean = float(np.dot(covered, sizes) / max(1, np.dot(need, sizes)))
            weights = base * np.exp(np.clip(STEP * (mean - ahead), -20, 20))
    used = max(1, sum(k for _, k in found.values()))
    best: list[tuple[np.ndarray, int]] | None = None
    for share in KEPT_SHARES if found else (1.0,):
        # the fractional counts rounded down; what is rounded off keeps its mix of lengths
        plan, left = [], need.copy()
        for config, k in sorted(found.values(), key=lambda x: (-x[1], x[0].tobytes())):
            full = config > 0
            times = min(int(max(1.0, share * bound * k / used)), int((left[full] // config[full]).min()))
            if times > 0 and np.dot(need - left, sizes) < share * bound * capacity:
                plan.append((config, times))
                left = left - config * times
        while left.any():  # the rest, longest first and filled as well as the rest allows
            start = np.zeros_like(left)
            start[np.flatnonzero(left)[-1]] = 1
            config = _fill(start, left, capacity)
            full = config > 0
            times = max(1, int((left[full] // config[full]).min()))
            plan.append((config, times))
            left = left - config * times
        if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
            best = plan
    return [({int(x): int(c[x]) for x in np.flatnonzero(c)}, t) for c, t in out + best]


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces a sequence, offset of the first): the pieces of a length,
    by rank, go to these sequences. As many rows as the plan's configurations have lengths."""
    rows, ranks, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            n = config[length] * times
            rows.append((length, ranks.get(length, 0), n, sequence, config[length], offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length * config[length]
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of cut (doc_id, piece, length and others) with sequence_id and offset.

    cut is read twice and must give the same rows both times; pass a written table.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows = slots(configurations(histogram, capacity))
    table = spark.createDataFrame(rows, "of long, first long, ranks long, sequence long, each long, place long") if rows else spark.createDataFrame([], "of long, first long, ranks long, sequence long, each long, place long")
    hashed = cut.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(hashed, ["length"], ["_h", "doc_id", "piece"], "_one", "_rank", hash_slice("_h", SLICES))
    # the slots of a length are intervals of ranks: an equi-join on the length and the interval's block of ranks would
    # repeat rows; the table is small (bounded by the capacity and the rounds), so it is broadcast
    on = (F.col("length") == F.col("of")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("ranks"))
    k = F.col("_rank") - F.col("first")
    return ranked.join(F.broadcast(table), on).withColumn("sequence_id", F.col("sequence") + F.expr("(_rank - first) div each")).withColumn("offset", F.col("place") + (k % F.col("each")) * F.col("length")).drop("_h", "_one", "_rank", *table.columns)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(written(pieces(docs, capacity, vocabulary), "pieces"), capacity)

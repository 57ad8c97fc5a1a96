"""Spark helpers shared by the operators: written intermediate tables, salted prefix sums, fixed-size filters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slices of a group in which running sums are taken; a slice holds about 1/1024 of its group.
SLICES = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Give memory that a task no longer uses back to the machine: workers live on, and their next task may be small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function over batches that releases memory when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let texts go to Python tasks in batches of fewer rows than Spark's default of 10,000, so that a task holds a few
    MB; a session that sets a number of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back: later steps neither recompute them nor
    depend on the executors that made them. ``compression``: another codec than the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written_meanwhile(df: DataFrame, name: str, compression: str | None = None):
    """As ``written``, for the length of a ``with`` block, in which what needs the rows is written; after it the folder
    holds none."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def most_frequent(counts: DataFrame, n: str, key: str, most: int) -> DataFrame:
    """At most so many rows of counts, the largest by n; of those that tie for the last places, the slices of hashed keys
    that fit. Only the numbers of rows of each n, and of each slice, come to the driver, so no task holds all candidates."""
    room = most
    for value, rows in sorted(((r[0], r[1]) for r in counts.groupBy(n).agg(F.count(F.lit(1))).collect()), reverse=True):
        if rows > room:
            break
        room -= rows
    else:
        return counts
    piece = F.pmod(F.xxhash64(key), F.lit(4 * SLICES))
    ties = counts.where(F.col(n) == value)
    end = 0
    for k, rows in sorted((r[0], r[1]) for r in ties.groupBy(piece).agg(F.count(F.lit(1))).collect()):
        if rows > room:
            break
        room, end = room - rows, k + 1
    return counts.where((F.col(n) > value) | ((F.col(n) == value) & (piece < end)))


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """In the block, a query's shuffle files go as soon as its rows are written or gathered, instead of when the driver
    happens to clean up. What is returned unrun is to be made after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def running_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, slice_of, slices: int = SLICES) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (0 for the first), in the given order.

    ``slice_of`` is a column of integers that grows with the order and cuts a group into ``slices`` pieces of similar
    size: sums run inside a slice, and the slices' totals (at most ``slices`` rows a group) run once more. No task sees a whole group.
    """
    cut = df.withColumn("_slice", slice_of)
    keys = [*group, "_slice"]
    totals = cut.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return cut.join(totals, on, "left").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def hash_slice(col: str, slices: int = SLICES):
    """Slice of a 64-bit hash, growing with the signed hash."""
    bits = slices.bit_length() - 1
    return F.shiftright(F.col(col), 64 - bits)


#: Bits of a key filter: 2**26 bits are 8 MB, whatever the number of keys.
FILTER_BITS = 26


def key_filter(keys: DataFrame, col: str, bits: int = FILTER_BITS):
    """A broadcast one-hash Bloom filter of the 64-bit keys. Its size is fixed (2**bits bits), so broadcasting it is safe
    at any input; a full one lets more through, and the exact join that must follow stays right."""
    spark = keys.sparkSession
    chunk = 1 << 16  # bits in a row: 8 KB
    mask = (1 << bits) - 1

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(chunk, dtype=bool)
        flags[table["at"].to_numpy()] = True
        return pa.table({"chunk": table["chunk"][:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    place = F.col(col).bitwiseAND(F.lit(mask))
    found = keys.select(F.shiftright(place, 16).alias("chunk"), place.bitwiseAND(F.lit(chunk - 1)).cast("int").alias("at")).distinct().groupBy("chunk").applyInArrow(pack, "chunk long, flags binary")
    whole = np.zeros((mask + 1) // 8, dtype=np.uint8)
    for row in found.toArrow().to_pylist():  # as large as the filter, in one job
        whole[row["chunk"] * (chunk // 8) : (row["chunk"] + 1) * (chunk // 8)] = np.frombuffer(row["flags"], np.uint8)
    return spark.sparkContext.broadcast(whole)


@contextlib.contextmanager
def freed(broadcast):
    """A broadcast for the length of a ``with`` block, in which what needs it is written; after it, it is gone from the
    driver and the executors."""
    try:
        yield broadcast
    finally:
        broadcast.destroy()


def in_filter(flags: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    at = keys.astype(np.int64) & ((1 << bits) - 1)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, col: str, flags, bits: int = FILTER_BITS, keep: bool = True) -> DataFrame:
    """Rows of df whose key may be among the filter's (``keep``: or the others, which surely are not); run before an
    exact join, to shuffle fewer rows."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index(col)).to_numpy(zero_copy_only=False)
            if len(keys):
                yield b.filter(pa.array(in_filter(flags.value, keys, bits) == keep))

    return df.mapInArrow(tidy(sift), df.schema)

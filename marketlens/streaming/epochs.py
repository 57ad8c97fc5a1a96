"""A table that a stream upserts into, epoch by epoch, so that a replayed batch or a crash changes nothing.

Under ``root/data`` each epoch writes the partitions that it touches as new files (``<partition>=.../epoch=N``), and never
changes older ones. Then one file under ``root/ledger`` says which epoch's files are each partition's current ones: with
that file, all partitions of the epoch change at once. A crash before it leaves the table as it was; an epoch that is in
the ledger is not run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Upserting = Callable[[DataFrame, DataFrame], DataFrame]


def _ledger(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("part string, from long, epoch long").parquet(f"{root}/ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def last_epoch(spark: SparkSession, root: str) -> int:
    """The newest epoch in the ledger; -1 before the first."""
    ledger = _ledger(spark, root)
    newest = None if ledger is None else ledger.agg(F.max("epoch")).first()[0]
    return -1 if newest is None else newest


def _current(spark: SparkSession, root: str, epoch: int) -> DataFrame:
    """part and from: the epoch whose files are the partition's current ones."""
    return _ledger(spark, root).where(F.col("epoch") == epoch).where("part is not null").select(F.col("part").alias("_part"), F.col("from").alias("_from"))


def _part(partition: str):
    """A partition's value as text; null is a value, too."""
    return F.coalesce(F.concat(F.lit("is "), F.col(partition).cast("string")), F.lit("null"))


def read_table(spark: SparkSession, root: str, schema: str | T.StructType, epoch: int | None = None) -> DataFrame:
    """The table as of an epoch (the newest). ``schema`` names its columns, the partition's included."""
    none = spark.createDataFrame([], schema)
    epoch = last_epoch(spark, root) if epoch is None else epoch
    if epoch < 0:
        return none
    rows = spark.read.schema(T.StructType([*none.schema.fields, T.StructField("_part", T.StringType()), T.StructField("_epoch", T.LongType())])).parquet(f"{root}/data")
    now = _current(spark, root, epoch).withColumnRenamed("_part", "_p")
    return rows.join(now, (F.col("_part") == F.col("_p")) & (F.col("_epoch") == F.col("_from"))).select(*none.columns)


def write_epoch(spark: SparkSession, incoming: DataFrame, root: str, partition: str, upserting: Upserting, epoch: int, fail: bool = False) -> bool:
    """Upsert a batch as an epoch; False where the ledger has it already. ``fail`` stops before the ledger, for tests."""
    last = last_epoch(spark, root)
    if epoch <= last:
        return False
    part = _part(partition)
    touched = incoming.select(part.alias("_part")).distinct()
    table = read_table(spark, root, incoming.schema, last).withColumn("_part", part)
    merged = upserting(table.join(touched, "_part", "left_semi").drop("_part"), incoming)
    out = merged.withColumns({"_part": part, "_epoch": F.lit(epoch).cast("long")})
    # an epoch that broke off before has files under its number: they are overwritten
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", "_epoch").parquet(f"{root}/data")
    if fail:
        raise RuntimeError("stopped before the ledger")
    new = touched.select(F.col("_part").alias("part"), F.lit(epoch).cast("long").alias("from"))
    if last >= 0:
        old = _current(spark, root, last).select(F.col("_part").alias("part"), F.col("_from").alias("from"))
        new = new.unionByName(old.join(new.select("part"), "part", "left_anti"))
    # one file with a row a partition, and one that counts the epoch where it touched nothing; the file makes it all true
    mark = spark.range(1).select(F.lit(None).cast("string").alias("part"), F.lit(epoch).cast("long").alias("from"))
    new.unionByName(mark).withColumn("epoch", F.lit(epoch).cast("long")).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return True


def upsert_stream(stream: DataFrame, root: str, partition: str, upserting: Upserting, checkpoint: str, mode: str = "append"):
    """Start the stream into the table, in an output mode. The query's own batch numbers are the epochs."""

    def batch(incoming: DataFrame, epoch: int) -> None:
        kept = incoming.persist()  # read for the partitions it touches and for its rows
        try:
            write_epoch(incoming.sparkSession, kept, root, partition, upserting, epoch)
        finally:
            kept.unpersist()

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Upserts: the table after an incoming batch. Running a batch again changes nothing.

Each works on (existing, incoming) frames of the same columns. ``write_partitions`` rewrites only the date partitions
that a batch touches, through a staged copy, since a path must not be overwritten while it is read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stacked(existing: DataFrame, incoming: DataFrame, order: str | None) -> DataFrame:
    """All rows with their precedence: incoming after existing, and within a batch by the order column."""
    seq = lambda n: F.struct(F.lit(n).alias("batch"), (F.col(order) if order else F.lit(0)).alias("at"))
    return existing.withColumn("_seq", seq(0)).unionByName(incoming.withColumn("_seq", seq(1)))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None, keep_first: tuple[str, ...] = (), newest_known: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: columns of the newest row, except those that keep their first value and those that keep the newest
    value that is not null."""
    rows = _stacked(existing, incoming, order)
    rest = [c for c in existing.columns if c not in (*keys, *keep_first, *newest_known)]
    aggs = [F.max_by(F.struct(*rest), "_seq").alias("_new")] if rest else []
    aggs += [F.min_by(c, "_seq").alias(c) for c in keep_first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in newest_known]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *(["_new.*"] if rest else []), *keep_first, *newest_known).select(*existing.columns)


def upsert_klines(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The first open price and source symbol stay."""
    return upsert(existing, incoming, ["symbol_id", "exchange", "interval", "open_time"], keep_first=("open_price", "source_symbol"))


def upsert_liquidations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Price, quantity and amounts are the newest; who, which side and when stay."""
    first = tuple(c for c in existing.columns if c not in ("event_key", "price", "quantity", "notional", "usd_value", "raw_data"))
    return upsert(existing, incoming, ["event_key"], keep_first=first)


def upsert_issues(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """first_seen_at stays, the rest is the newest, and an issue seen again that was resolved is open again."""
    again = incoming.select("issue_key").distinct().withColumn("_again", F.lit(True))
    old = existing.select("issue_key", F.col("status").alias("_old"))
    out = upsert(existing, incoming, ["issue_key"], order="last_seen_at", keep_first=("first_seen_at",))
    out = out.join(again, "issue_key", "left").join(old.distinct(), "issue_key", "left")
    status = F.when(F.col("_again") & F.col("_old").isNotNull(), F.when(F.col("_old") == "resolved", "open").otherwise(F.col("_old"))).otherwise(F.col("status"))
    return out.withColumn("status", status).select(*existing.columns)


def upsert_gaps(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What is known of the gap is the newest; how its backfill stands stays."""
    return upsert(existing, incoming, ["gap_key"], order="detected_at", keep_first=("backfill_status",))


def upsert_health(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("collector", "exchange")) -> DataFrame:
    """The times of the last success and the last error are only replaced by something known; a blank error is none."""
    blank = lambda df: df.withColumn("last_error", F.nullif("last_error", F.lit("")))
    return upsert(blank(existing), blank(incoming), list(keys), order="heartbeat_at", newest_known=("last_success_at", "last_error_at"))


def market_structure_rows(structure: DataFrame) -> DataFrame:
    """Market structure as its table keeps it: some columns under a second name, too."""
    mirrored = {"trend": "trend_direction", "support_price": "last_swing_low", "resistance_price": "last_swing_high", "breakout_state": "structure_state"}
    return structure.withColumns({new: F.col(old) for new, old in mirrored.items()})


def divergence_rows(divergence: DataFrame) -> DataFrame:
    """Divergence as its table keeps it: the metadata also as metrics and as quality metadata."""
    return divergence.withColumns({"metrics": F.col("metadata"), "quality_metadata": F.col("metadata")})


def aggregate_rows(records: DataFrame) -> DataFrame:
    """Aggregate records as their table keeps them: the weighted price under a second name, and the venues' payloads also
    as raw data; JSON that is missing is an empty object."""
    json = ("available_exchanges", "raw_by_exchange", "window_metrics", "metrics", "quality_metadata", "anomaly_flags")
    out = records.withColumns({c: F.coalesce(c, F.lit("{}")) for c in json})
    return out.withColumns({"weighted_price": F.col("price_weighted"), "raw_data": F.col("raw_by_exchange")})


def upsert_aggregates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every column of a symbol's instant is the newest, also where that is null."""
    return upsert(aggregate_rows(existing), aggregate_rows(incoming), ["symbol_id", "snapshot_time"])


def volatility_rows(volatility: DataFrame) -> DataFrame:
    """Volatility as its table keeps it: blank texts are null, and raw data that is missing is an empty object."""
    out = volatility.withColumns({c: F.nullif(c, F.lit("")) for c in ("market_type", "source_symbol")})
    return out.withColumn("raw_data", F.coalesce("raw_data", F.lit("{}")))


def upsert_volatility(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(volatility_rows(existing), volatility_rows(incoming), ["symbol_id", "exchange", "period", "snapshot_time"])


def upsert_market_structure(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(market_structure_rows(existing), market_structure_rows(incoming), ["symbol_id", "exchange", "period", "snapshot_time"])


def upsert_divergence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(divergence_rows(existing), divergence_rows(incoming), ["symbol_id", "data_type", "reference_exchange", "compared_exchange", "snapshot_time"])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one of each key (the smallest by its other columns); existing rows stay."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*incoming.columns) if rest else incoming.distinct()
    new = one.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new)


def write_partitions(spark, df: DataFrame, path: str, partition: str, upserting, staging: str) -> None:
    """Merge df into the Parquet table at path, partitioned by ``partition``: read the touched partitions, merge, stage,
    and overwrite only them. ``upserting`` is (existing, incoming) to merged."""
    touched = df.select(partition).distinct()
    try:
        table = spark.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = df.limit(0)  # the first batch makes the table
    merged = upserting(table.join(touched, partition, "left_semi").select(*df.columns), df)
    stage = f"{staging.rstrip('/')}/stage-{uuid.uuid4().hex}"
    merged.write.parquet(stage)
    spark.read.schema(merged.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

"""Expiring old rows and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import micros
from marketlens.operators.candles import LEVELS, rollup_klines


def eligible(df: DataFrame, time_col: str, cutoff, interval: str | None = None) -> DataFrame:
    """Rows before the cutoff, of one interval if given."""
    out = df.where(micros(time_col) < micros(F.lit(cutoff).cast("timestamp")))
    return out if interval is None else out.where(F.col("interval") == interval)


def eligible_count(df: DataFrame, time_col: str, cutoff, interval: str | None = None) -> DataFrame:
    return eligible(df, time_col, cutoff, interval).agg(F.count(F.lit(1)).alias("eligible_rows"))


def expire(df: DataFrame, time_col: str, cutoff, interval: str | None = None, max_rows: int | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): the oldest eligible rows go, at most max_rows of them, ties by the keys; the two partition df.

    The cap is found as a bound in the order, from the top max_rows (a bounded list), not by numbering all rows.
    """
    order = F.struct(micros(time_col).alias("t"), *keys, F.xxhash64(*df.columns).alias("h"))
    old = micros(time_col) < micros(F.lit(cutoff).cast("timestamp"))
    if interval is not None:
        old &= F.col("interval") == interval
    old = F.coalesce(old, F.lit(False))
    if max_rows is None:
        return df.where(~old), df.where(old)
    marked = df.withColumn("_old", old).withColumn("_order", order)
    bound = marked.where("_old").select("_order").orderBy("_order").limit(max_rows).agg(F.max("_order").alias("_bound"))
    goes = F.coalesce(F.col("_old") & (F.col("_order") <= F.col("_bound")), F.lit(False))
    both = marked.join(F.broadcast(bound), F.lit(True), "left").withColumn("_goes", goes)
    return both.where("not _goes").select(*df.columns), both.where("_goes").select(*df.columns)


def rollup_then_expire(klines: DataFrame, source: str, cutoff, max_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rolled up candles, kept, expired). Only candles can be rolled up; nothing expires that was not."""
    seconds = LEVELS[source][1]
    aligned = (F.floor(F.unix_seconds(F.lit(cutoff).cast("timestamp")) / seconds) * seconds).cast("timestamp")
    rolled = rollup_klines(klines, source, cutoff)
    kept, expired = expire(klines, "open_time", aligned, source, max_rows, ("symbol_id", "exchange"))
    return rolled, kept, expired


# How partitions are named after their parent table, by month or by ISO week.
MONTHLY, WEEKLY = r"(?i)_(\d{4})_(\d{2})$", r"(?i)_(\d{4})_w(\d{2})$"


def expired_partitions(names: DataFrame, cutoff, column: str = "name", parent: str | None = None) -> DataFrame:
    """Partitions ``..._YYYY_MM`` or ``..._YYYY_wWW`` (ISO weeks, either case) whose range ends by the cutoff: name,
    range_start, range_end. With a parent table, only names that begin with its name. Other names are never expired."""
    name = F.trim(column)
    year = lambda p: F.try_to_number(F.regexp_extract(name, p, 1), F.lit("9999")).cast("int")
    part = lambda p: F.try_to_number(F.regexp_extract(name, p, 2), F.lit("99")).cast("int")
    month = F.when(name.rlike(MONTHLY) & part(MONTHLY).between(1, 12), F.make_date(year(MONTHLY), part(MONTHLY), F.lit(1)))
    fourth = F.make_date(year(WEEKLY), F.lit(1), F.lit(4))  # always in week 1
    week = F.when(name.rlike(WEEKLY) & part(WEEKLY).between(1, 53), F.date_add(F.date_trunc("week", fourth).cast("date"), (part(WEEKLY) - 1) * 7))
    start = F.coalesce(month, week)
    end = F.when(month.isNotNull(), F.add_months(month, 1)).otherwise(F.date_add(week, 7))
    out = names.where(F.lower(name).startswith(parent.lower() + "_")) if parent else names
    out = out.withColumn("range_start", start).withColumn("range_end", end)
    return out.where(F.col("range_end").cast("timestamp") <= F.lit(cutoff).cast("timestamp")).select(column, "range_start", "range_end")

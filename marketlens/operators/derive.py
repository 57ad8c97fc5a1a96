"""Filled-in and derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import event_usd, time_bucket, total


def fill_taker_flow(flows: DataFrame) -> DataFrame:
    c = F.col
    return flows.withColumns({
        "buy_sell_delta": F.coalesce(c("buy_sell_delta"), c("taker_buy_volume") - c("taker_sell_volume")),
        "buy_sell_delta_quote": F.coalesce(c("buy_sell_delta_quote"), c("taker_buy_quote_volume") - c("taker_sell_quote_volume")),
        "buy_sell_ratio": F.coalesce(c("buy_sell_ratio"), F.try_divide(c("taker_buy_volume"), c("taker_sell_volume"))),
    })


def fill_liquidation_totals(aggregates: DataFrame) -> DataFrame:
    """A zero amount takes its notional, then a zero total takes the sum of both sides."""
    out = aggregates
    zero = lambda target, value: F.when(F.col(target) == 0, value).otherwise(F.col(target))
    for side in ("long", "short"):
        out = out.withColumn(f"{side}_liquidation_usd", zero(f"{side}_liquidation_usd", F.col(f"{side}_liquidation_notional")))
    out = out.withColumn("total_liquidation_usd", zero("total_liquidation_usd", F.col("long_liquidation_usd") + F.col("short_liquidation_usd")))
    return out.withColumn("total_liquidation_notional", zero("total_liquidation_notional", F.col("long_liquidation_notional") + F.col("short_liquidation_notional")))


def fill_basis(basis: DataFrame) -> DataFrame:
    """basis and basis_value mirror each other, else are futures less index; the percentage is over the index."""
    c = F.col
    value = F.coalesce(c("basis_value"), c("basis"), c("futures_price") - c("index_price"))
    out = basis.withColumn("basis_value", value).withColumn("basis", F.coalesce(c("basis"), value))
    return out.withColumn("basis_percent", F.coalesce(c("basis_percent"), F.try_divide(c("basis_value"), c("index_price")) * 100))


def liquidation_usd(events: DataFrame) -> DataFrame:
    return events.withColumn("usd_value", event_usd())


def at_least_usd(events: DataFrame, usd: float = 1000.0) -> DataFrame:
    """Events worth keeping one by one; aggregates are made from all events."""
    return events.where(event_usd() >= usd)


def open_interest_from_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.where(F.col("open_interest").isNotNull()).select("symbol_id", "exchange", "source_symbol", "snapshot_time", "open_interest", F.lit(None).cast("double").alias("open_interest_value"), "raw_data")


def funding_from_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.where(F.col("funding_rate").isNotNull()).select("symbol_id", "exchange", "source_symbol", "snapshot_time", "funding_rate", "mark_price", "index_price", "raw_data")


def cumulative_delta(flows: DataFrame, scale: int | None = None) -> DataFrame:
    """Running total of the taker delta per (symbol, venue, period), its change and the change in percent of the total
    before (0 where that is 0). Rows without a delta are skipped.

    The running total goes over days: each day's sum first, then the rows of a day, so a long history is many tasks.
    """
    f = fill_taker_flow(flows)
    change = F.coalesce("buy_sell_delta_quote", "buy_sell_delta")
    f = f.withColumn("cvd_delta", change).where("cvd_delta is not null").withColumn("_day", F.to_date("snapshot_time"))
    exact = F.col("cvd_delta") if scale is None else F.col("cvd_delta").cast(f"decimal(28,{scale})")
    keys = ["symbol_id", "exchange", "period"]
    days = f.groupBy(*keys, "_day").agg(F.sum(exact).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(days.schema["_sum"].dataType)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_sum").over(earlier), zero).alias("_before"))
    within = Window.partitionBy(*keys, "_day").orderBy("snapshot_time").rowsBetween(Window.unboundedPreceding, 0)
    out = f.join(days, [*keys, "_day"]).withColumn("cvd_value", (F.col("_before") + F.sum(exact).over(within)).cast("double"))
    before = (F.col("_before") + F.sum(exact).over(within) - exact).cast("double")
    out = out.withColumn("_previous", before)
    percent = F.when(F.col("_previous") != 0, F.col("cvd_delta") / F.col("_previous") * 100).otherwise(0.0)
    return out.select(*keys, "snapshot_time", "cvd_value", "cvd_delta", F.col("cvd_delta").alias("cvd_change"), percent.alias("cvd_change_percent"), F.col("taker_buy_volume").alias("buy_volume"), F.col("taker_sell_volume").alias("sell_volume"), "raw_data")


def liquidation_buckets(events: DataFrame, period: str | None = None, tier: str = "all", scale: int | None = None) -> DataFrame:
    """Liquidations per (symbol, venue, bucket): sells and longs are long, anything else is short. Buckets have five
    minutes for period 5m, else one; without a period, 5m for tier all, else 1m."""
    period = (period or "").strip() or ("5m" if tier.lower() == "all" else "1m")
    seconds = 300 if period.lower() == "5m" else 60
    e = events.where(F.col("event_time").isNotNull() & (F.coalesce("symbol_id", F.lit(0)) != 0))
    long_ = F.lower(F.trim("side")).isin("sell", "long")
    e = e.withColumn("usd", event_usd()).withColumn("_long", F.coalesce(long_, F.lit(False)))
    part = lambda cond: F.coalesce(total(F.when(cond, F.col("usd")), scale), F.lit(0.0))
    out = e.groupBy("symbol_id", "exchange", time_bucket("event_time", seconds).alias("bucket_time")).agg(
        F.count_if("_long").alias("long_liquidation_count"),
        F.count_if(~F.col("_long")).alias("short_liquidation_count"),
        part(F.col("_long")).alias("long_liquidation_usd"),
        part(~F.col("_long")).alias("short_liquidation_usd"),
        F.coalesce(total("usd", scale), F.lit(0.0)).alias("total_liquidation_usd"),
        F.greatest(F.lit(0.0), F.max("usd")).alias("largest_liquidation_usd"),
    )
    return out.withColumn("period", F.lit(period)).withColumns({f"{s}_liquidation_notional": F.col(f"{s}_liquidation_usd") for s in ("long", "short", "total")})

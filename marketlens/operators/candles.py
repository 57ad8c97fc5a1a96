"""Candles, rollups, market structure and volatility."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import mean, shallow_healthy, time_bucket, total
from marketlens.operators import trailing
from marketlens.operators.trailing import window_stats
from marketlens.options import DAY, WINDOWS

#: Rollup levels: source interval, target interval and the target's seconds.
LEVELS = {"1m": ("5m", 300), "5m": ("15m", 900), "15m": ("1h", 3600), "1h": ("4h", 14_400), "4h": ("1d", 86_400)}


def eligible(klines: DataFrame, interval: str = "5m") -> DataFrame:
    """Closed, healthy candles of the interval with positive prices."""
    prices = [F.col(c) > 0 for c in ("open_price", "high_price", "low_price", "close_price")]
    keep = (F.col("interval") == interval) & F.col("is_closed") & shallow_healthy("raw_data")
    for p in prices:
        keep &= p
    return klines.where(keep)


def venue_candles(klines: DataFrame, interval: str = "5m", scale: int | None = None) -> DataFrame:
    """One candle per (symbol, open_time): average open and close, highest high and lowest low over the venues."""
    return eligible(klines, interval).groupBy("symbol_id", "open_time").agg(mean("open_price", scale).alias("open"), F.max("high_price").alias("high"), F.min("low_price").alias("low"), mean("close_price", scale).alias("close"))


def rollup_klines(klines: DataFrame, source: str, cutoff=None, scale: int | None = None) -> DataFrame:
    """Closed candles of one interval combined into the next; with a cutoff, only those before it, aligned down to the
    target's bucket so that no bucket is rolled up in part."""
    target, seconds = LEVELS[source]
    k = klines.where((F.col("interval") == source) & F.col("is_closed"))
    if cutoff is not None:
        k = k.where(F.col("open_time") < time_bucket(F.lit(cutoff), seconds))
    at, late = F.struct("open_time", "close_time"), F.struct("open_time", "close_time")
    out = k.groupBy("symbol_id", "exchange", time_bucket("open_time", seconds).alias("bucket")).agg(
        F.max_by("source_symbol", late).alias("source_symbol"),
        F.max("close_time").alias("close_time"),
        F.min_by("open_price", at).alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", late).alias("close_price"),
        total("volume", scale).alias("volume"),
        total("quote_volume", scale).alias("quote_volume"),
        F.sum("trade_count").alias("trade_count"),
        F.count(F.lit(1)).alias("source_rows"),
    )
    raw = F.to_json(F.struct(F.lit(True).alias("rollup"), F.lit(source).alias("source_interval"), F.lit(target).alias("target_interval"), "source_rows"))
    return out.select("symbol_id", "exchange", "source_symbol", F.lit(target).alias("interval"), F.col("bucket").alias("open_time"), "close_time", "open_price", "high_price", "low_price", "close_price", "volume", "quote_volume", "trade_count", F.lit(True).alias("is_closed"), raw.alias("raw_data"), "source_rows")


def rollup_chain(klines: DataFrame, source: str, target: str, scale: int | None = None) -> DataFrame:
    """Candles of the target interval, each level made from the one before it."""
    while source != target:
        klines = rollup_klines(klines, source, scale=scale)
        source = LEVELS[source][0]
    return klines


def rollup_probe(klines: DataFrame, source: str, cutoff) -> DataFrame:
    """First open time before the cutoff (the cutoff, if there is none) and how many rows there are."""
    k = klines.where((F.col("interval") == source) & F.col("is_closed") & (F.col("open_time") < F.lit(cutoff).cast("timestamp")))
    return k.agg(F.coalesce(F.min("open_time"), F.lit(cutoff).cast("timestamp")).alias("window_start"), F.count(F.lit(1)).alias("row_count"))


def market_structure(candles: DataFrame, grid: DataFrame, windows: Mapping[str, int] = WINDOWS) -> DataFrame:
    """Trend, state, swing levels, position and support and resistance over the candles in ``[as_of - w, as_of]``."""
    close, priced = F.col("close"), F.col("close").isNotNull()
    stats = {
        "candles": trailing.count(close),
        "first_close": trailing.first(close, priced),
        "last_close": trailing.last(close, priced),
        "high": trailing.highest(F.col("high")),
        "low": trailing.lowest(F.col("low")),
        "lows": trailing.levels(F.col("low"), largest=False),
        "highs": trailing.levels(F.col("high"), largest=True),
    }
    s = window_stats(candles.select("symbol_id", "open_time", "high", "low", "close"), grid, "open_time", windows, stats, closed=True)
    enough = F.col("candles") >= 2
    change = F.coalesce(F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close")) * 100, F.lit(0.0))
    wide = F.coalesce(F.try_divide(F.col("high") - F.col("low"), F.col("last_close")) * 100, F.lit(0.0))
    s = s.withColumn("price_change_percent", F.when(enough, change)).withColumn("range_percent", F.when(enough, wide))
    trend = F.when(~enough, "unknown").when(change > 0.2, "bullish").when(change < -0.2, "bearish").otherwise("sideways")
    state = F.when(~enough, "unknown").when(wide < 1, "compression").when((wide > 5) | (F.abs(change) > 3), "expansion").otherwise("ranging")
    none = F.array().cast("array<double>")
    return s.select(
        "symbol_id", "as_of", F.col("window").alias("period"), "candles", trend.alias("trend_direction"), state.alias("structure_state"),
        F.when(enough, F.col("high")).alias("last_swing_high"), F.when(enough, F.col("low")).alias("last_swing_low"),
        F.when(enough & (F.col("high") > F.col("low")), (F.col("last_close") - F.col("low")) / (F.col("high") - F.col("low")) * 100).alias("price_position"),
        F.when(enough, F.col("lows")).otherwise(none).alias("support_levels"), F.when(enough, F.col("highs")).otherwise(none).alias("resistance_levels"),
        "price_change_percent", "range_percent", F.when(~enough, "insufficient_candles").alias("reason"),
    )


def volatility(candles: DataFrame, grid: DataFrame, windows: Mapping[str, int] = WINDOWS, scale: int | None = None) -> DataFrame:
    """Average true range, realised volatility and ranges over the candles in ``[as_of - w, as_of]``.

    True range and return look at the candle before; a window's first candle has none, so its own part is taken out of
    the window's sums again. With no candle in a window all measures are null.
    """
    c = _with_previous_close(candles.select("symbol_id", "open_time", "high", "low", "close"))
    own = F.col("high") - F.col("low")
    c = c.withColumn("hl", own).withColumn("tr", F.greatest(own, F.abs(F.col("high") - F.col("p")), F.abs(F.col("low") - F.col("p"))))
    c = c.withColumn("r", F.when((F.col("p") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("p")))).drop("p")
    if scale is not None:  # exact sums, so that taking a part out again leaves no trace
        c = c.withColumns({k: F.col(k).cast(f"decimal(28,{scale})") for k in ("hl", "tr")})
    priced = F.col("close").isNotNull()
    stats = {"n": trailing.count(F.col("close")), "high": trailing.highest(F.col("high")), "low": trailing.lowest(F.col("low")), "close": trailing.last(F.col("close"), priced), "tr": trailing.total(F.col("tr")), "returns": trailing.moments(F.col("r"))}
    stats |= {f"first_{k}": trailing.first(F.col(k), priced) for k in ("hl", "tr", "r")}
    ranges = {"24h": DAY, "7d": 7 * DAY}
    s = window_stats(c, grid, "open_time", {**{f"range_{k}": w for k, w in ranges.items() if windows.get(k) != w}, **windows}, stats, closed=True)
    atr = (F.col("tr") - F.col("first_tr") + F.col("first_hl")).cast("double") / F.nullif(F.col("n"), F.lit(0))
    # moments of the returns without the first candle's
    n, mean, x = F.col("returns.n"), F.col("returns.mean"), F.col("first_r")
    fewer = n - F.when(x.isNotNull(), 1).otherwise(0)
    left = F.when(x.isNull(), F.col("returns.m2")).otherwise(F.col("returns.m2") - (x - mean) * (x - F.try_divide(n * mean - x, n - 1)))
    vol = F.when(fewer >= 2, F.sqrt(F.greatest(F.lit(0.0), left / (fewer - 1))) * F.sqrt(fewer))
    percent = F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100
    rows = s.select("symbol_id", "as_of", F.col("window").alias("period"), F.col("n").alias("candles"), F.col("high").alias("high_price"), F.col("low").alias("low_price"), F.col("close").alias("close_price"), atr.alias("atr"), (F.try_divide(atr, F.col("close")) * 100).alias("atr_percent"), vol.alias("realized_volatility"), (vol * 100).alias("realized_volatility_percent"), percent.alias("_range"))
    label = {k: k if windows.get(k) == w else f"range_{k}" for k, w in ranges.items()}
    # an instant's windows side by side: as many as there are labels
    each = rows.groupBy("symbol_id", "as_of").agg(F.collect_list(F.struct(*rows.columns[2:])).alias("_w"), *[F.max(F.when(F.col("period") == name, F.col("_range"))).alias(f"_{k}") for k, name in label.items()])
    out = each.select("symbol_id", "as_of", F.explode("_w").alias("_r"), *[f"_{k}" for k in label]).select("symbol_id", "as_of", "_r.*", *[f"_{k}" for k in label]).where(F.col("period").isin(*windows))
    return out.withColumns({f"range_percent_{k}": F.when(F.col("candles") > 0, F.col(f"_{k}")) for k in label}).drop("_range", *[f"_{k}" for k in label])


def _with_previous_close(candles: DataFrame) -> DataFrame:
    """candles with p, the close of the symbol's candle before; days first, so that a long history is many tasks."""
    c = candles.withColumn("_day", F.to_date("open_time"))
    days = c.groupBy("symbol_id", "_day").agg(F.max_by("close", "open_time").alias("_close"))
    days = days.select("symbol_id", "_day", F.lag("_close").over(Window.partitionBy("symbol_id").orderBy("_day")).alias("_before"))
    day = Window.partitionBy("symbol_id", "_day").orderBy("open_time")
    c = c.withColumn("_inside", F.lag("close").over(day)).withColumn("_at", F.row_number().over(day)).join(days, ["symbol_id", "_day"])
    return c.withColumn("p", F.when(F.col("_at") == 1, F.col("_before")).otherwise(F.col("_inside"))).drop("_day", "_inside", "_at", "_before")

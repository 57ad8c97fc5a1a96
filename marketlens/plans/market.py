"""Queries of the market operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import scalars as fn
from marketlens.operators import aggregates, asof, candles, derive, gaps, ops, retention, serve, sinks, validate
from marketlens.options import DAY, HOUR, AnalyticsOptions, FlagThresholds, ListOptions, ValidationOptions
from marketlens.sources import market, payloads

WINDOWS = {"1h": HOUR, "4h": 4 * HOUR, "24h": DAY, "7d": 7 * DAY}
OPTIONS = AnalyticsOptions(max_age=DAY, windows=WINDOWS, liquidation_lookback=300_000_000, sum_scale=6)
NOW = "2024-01-31 00:00:00"


def _naive(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


def venue_asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    return _naive(asof.asof_latest(t, market.grid(t), "snapshot_time", DAY).select("symbol_id", "as_of", "exchange", "snapshot_time", "last_price", "open_interest"))


def latest_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(asof.latest_by_key(market.ticks(spark, sf), ["symbol_id", "exchange"], "snapshot_time").select("symbol_id", "exchange", "snapshot_time", "last_price"))


def aggregate_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    out = aggregates.aggregate_snapshot(t, market.grid(t), OPTIONS)
    return _naive(out.withColumn("available_exchanges", F.array_join("available_exchanges", ",")).withColumn("skipped_exchanges", F.array_join("skipped_exchanges", ",")).drop("invalid_fields"))


def raw_by_exchange(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    m = aggregates.raw_by_exchange(t, market.grid(t, "6 hours"), OPTIONS)
    return _naive(m.select("symbol_id", "as_of", F.array_join(F.map_keys("raw_by_exchange"), ",").alias("venues"), F.array_join(F.map_values("raw_by_exchange"), ";").alias("payloads")))


def _liquidation_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return derive.liquidation_buckets(market.liquidations(spark, sf), scale=6)


def _cvd(spark: SparkSession, sf: str) -> DataFrame:
    return derive.cumulative_delta(market.taker_flows(spark, sf), scale=6)


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    tables = {"taker_flow": derive.fill_taker_flow(market.taker_flows(spark, sf)), "cvd": _cvd(spark, sf), "basis": market.basis(spark, sf), "liquidations": _liquidation_buckets(spark, sf)}
    return _naive(aggregates.enrichment(tables, market.grid(t), OPTIONS))


def enrichment_book(spark: SparkSession, sf: str) -> DataFrame:
    """Depth and imbalance of the venues' newest books."""
    return _naive(aggregates.enrichment({"orderbook": market.books(spark, sf)}, market.grid(market.ticks(spark, sf)), OPTIONS))


def point_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    return _naive(aggregates.point_aggregate(t, market.grid(t), OPTIONS))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    liq = _liquidation_buckets(spark, sf).withColumn("raw_data", F.lit("{}"))
    tables = {"ticks": t, "funding": derive.funding_from_ticks(t), "taker_flow": market.taker_flows(spark, sf), "cvd": _cvd(spark, sf), "liquidations": liq, "basis": market.basis(spark, sf)}
    return aggregates.window_metrics(tables, market.grid(t), OPTIONS)


def market_point_change(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    out = aggregates.window_metrics({"ticks": t}, market.grid(t), OPTIONS)
    return _naive(out.select("symbol_id", "as_of", "window", "price_change", F.round("price_change_pct", 6).alias("price_change_pct"), "volume_change", "oi_change"))


def window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(_metrics(spark, sf).select("symbol_id", "as_of", "window", "start_time", "cvd_change", "funding_avg", "funding_min", "funding_max", "taker_delta", "liquidation_sum_usd", "basis_avg", "basis_min", "basis_max"))


def anomaly_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = aggregates.anomaly_flags(_metrics(spark, sf), thresholds=FlagThresholds(liquidation_usd=100_000.0, basis_percent=0.5, funding_rate=0.004))
    return _naive(flags)


def exchange_divergence(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    return _naive(aggregates.exchange_divergence(t, market.grid(t), OPTIONS))


def venue_candles(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(candles.venue_candles(market.klines(spark, sf), scale=6))


def kline_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Five minutes to a day, level by level."""
    return _naive(candles.rollup_chain(market.klines(spark, sf), "5m", "1d", scale=6).drop("raw_data", "is_closed", "interval"))


def weekly_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup rule over daily sales bars, by calendar week."""
    b = market.daily_bars(spark, sf)
    at = F.struct("open_time", "l_orderkey", "l_linenumber", "l_partkey", "volume", "price")
    out = b.groupBy("symbol_id", "exchange", F.date_trunc("week", "open_time").alias("week")).agg(F.min_by("price", at).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", at).alias("close_price"), fn.total("volume", 2).alias("volume"), F.count(F.lit(1)).alias("source_rows"))
    return _naive(out)


def rollup_probe(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(candles.rollup_probe(market.klines(spark, sf), "5m", "2024-01-15 00:00:00"))


def market_structure(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    out = candles.market_structure(candles.venue_candles(market.klines(spark, sf), scale=6), market.grid(t, "6 hours"), WINDOWS)
    rounded = [F.round(c, 6).alias(c) for c in ("price_position", "price_change_percent", "range_percent")]
    return _naive(out.select("symbol_id", "as_of", "period", "candles", "trend_direction", "structure_state", "last_swing_high", "last_swing_low", *rounded, "reason"))


def support_resistance(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    out = candles.market_structure(candles.venue_candles(market.klines(spark, sf), scale=6), market.grid(t, "6 hours"), WINDOWS)
    level = lambda side, k: F.get(f"{side}_levels", k).alias(f"{side}_{k + 1}")
    return _naive(out.select("symbol_id", "as_of", "period", *[level(s, k) for s in ("support", "resistance") for k in range(3)]))


def near_equal_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of coarse prices that lie within fractions of a billionth of one another."""
    t = market.ticks(spark, sf)
    c = candles.venue_candles(market.klines(spark, sf), scale=6)
    tiny = (F.unix_seconds("open_time") / 300).cast("long") % 60 * F.lit(3e-11)
    c = c.withColumns({"low": F.floor(F.col("low") / 100) + 1 + tiny, "high": F.floor(F.col("high") / 100) + 1 + tiny})
    out = candles.market_structure(c, market.grid(t, "6 hours"), WINDOWS)
    level = lambda side, k: F.get(f"{side}_levels", k).alias(f"{side}_{k + 1}")
    return _naive(out.select("symbol_id", "as_of", "period", *[level(s, k) for s in ("support", "resistance") for k in range(3)]))


def volatility(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    out = candles.volatility(candles.venue_candles(market.klines(spark, sf), scale=6), market.grid(t, "6 hours"), WINDOWS, 6)
    return _naive(out.select("symbol_id", "as_of", "period", "candles", "high_price", "low_price", "close_price", "atr", F.round("realized_volatility", 6).alias("realized_volatility"), "range_percent_24h", "range_percent_7d"))


def taker_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(derive.fill_taker_flow(market.taker_flows(spark, sf)).select("symbol_id", "exchange", "snapshot_time", "taker_buy_volume", "taker_sell_volume", "buy_sell_delta", "buy_sell_delta_quote", "buy_sell_ratio", fn.taker_delta().alias("best_delta")))


def basis_fill(spark: SparkSession, sf: str) -> DataFrame:
    b = market.basis(spark, sf).withColumn("basis_percent", F.lit(None).cast("double"))
    return _naive(derive.fill_basis(b).select("symbol_id", "exchange", "snapshot_time", F.round("basis", 6).alias("basis"), F.round("basis_value", 6).alias("basis_value"), F.round("basis_percent", 6).alias("basis_percent")))


def cumulative_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(_cvd(spark, sf).withColumn("cvd_change_percent", F.round("cvd_change_percent", 6)).drop("raw_data"))


def liquidation_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(_liquidation_buckets(spark, sf))


def liquidation_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets stripped of their amounts, filled in again from the notionals."""
    b = _liquidation_buckets(spark, sf)
    zero = {c: F.lit(0.0) for c in ("long_liquidation_usd", "short_liquidation_usd", "total_liquidation_usd", "total_liquidation_notional")}
    return _naive(derive.fill_liquidation_totals(b.withColumns(zero)).select("symbol_id", "exchange", "bucket_time", "long_liquidation_usd", "short_liquidation_usd", F.round("total_liquidation_usd", 4).alias("total_liquidation_usd"), F.round("total_liquidation_notional", 4).alias("total_liquidation_notional")))


def large_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    e = derive.at_least_usd(derive.liquidation_usd(market.liquidations(spark, sf)))
    return _naive(e.select("event_key", "symbol_id", "exchange", "event_time", "side", F.round("usd_value", 4).alias("usd_value")))


def derived_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(derive.open_interest_from_ticks(market.ticks(spark, sf)).drop("raw_data"))


def derived_funding(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(derive.funding_from_ticks(market.ticks(spark, sf)).drop("raw_data"))


def _spoiled(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with faults put in by k: no venue, in the future, a wild funding rate, a negative price."""
    k = F.col("k")
    t = market.ticks(spark, sf)
    return t.withColumns({"exchange": F.when(k == 3, " ").otherwise(F.col("exchange")), "snapshot_time": F.when(k == 5, F.col("snapshot_time") + F.expr("interval 400 days")).otherwise(F.col("snapshot_time")), "funding_rate": F.when(k == 7, F.lit(0.25)).otherwise(F.col("funding_rate")), "last_price": F.when(k.isin(7, 11), -F.col("last_price")).otherwise(F.col("last_price"))})


def quarantine_valid(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = validate.quarantine(_spoiled(spark, sf), "market_snapshot", NOW, ValidationOptions())
    return _naive(valid.select("event_id", "symbol_id", "exchange", "snapshot_time", "last_price", "funding_rate"))


def quarantine_issues(spark: SparkSession, sf: str) -> DataFrame:
    _, issues = validate.quarantine(_spoiled(spark, sf), "market_snapshot", NOW, ValidationOptions())
    return issues.groupBy("symbol_id", "exchange", "data_type", "issue_type", "error", "severity").agg(F.count(F.lit(1)).alias("issues"))


def kline_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(gaps.kline_gaps(market.klines(spark, sf), "5m", 3600, 20 * DAY, NOW).select("symbol_id", "exchange", "gap_start", "gap_end", "data_type", "period", "gap_key"))


def stale_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(gaps.stale_latest(market.ticks(spark, sf), "ticker", 1800, "2024-01-30 22:00:00").select("symbol_id", "exchange", "gap_start", "gap_end", "detector"))


def _policies(spark: SparkSession, sf: str) -> DataFrame:
    """One hourly tick policy a venue that has ticks."""
    return market.ticks(spark, sf).select("exchange").distinct().withColumns({"data_type": F.lit("ticker"), "period": F.lit("1h"), "interval_seconds": F.lit(3600), "enabled": F.lit(True)})


def stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Stale series of ticks, open interest, funding and aggregates, each against its own interval."""
    t = market.ticks(spark, sf)
    tables = {"ticker": t, "open_interest": derive.open_interest_from_ticks(t.where("exchange <> 'view'")), "funding": derive.funding_from_ticks(t), "aggregated_snapshot": _snapshots(spark, sf)}
    seconds = {"ticker": 1800, "open_interest": 3600, "funding": 7200, "aggregated_snapshot": 300}
    return _naive(gaps.stale_sources(tables, seconds, "2024-01-30 22:00:00").select("symbol_id", "exchange", "source_symbol", "data_type", "gap_start", "gap_end", "expected_interval_seconds", "detector"))


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    runs = gaps.missing_runs(_policies(spark, sf), t.select("symbol_id", "exchange").distinct(), t, "2024-01-02", "2024-01-29")
    return _naive(gaps.run_slots(runs).select("symbol_id", "exchange", "data_type", "slot_time", "slot_key"))


def coverage_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of hours without a tick, found without listing the hours that have one."""
    t = market.ticks(spark, sf)
    runs = gaps.missing_runs(_policies(spark, sf), t.select("symbol_id", "exchange").distinct(), t, "2024-01-02", "2024-01-29")
    hour = lambda c: F.timestamp_micros(F.col(c) * HOUR)
    return _naive(runs.select("symbol_id", "exchange", "data_type", hour("first_slot").alias("first_hour"), hour("last_slot").alias("last_hour"), (F.col("last_slot") - F.col("first_slot") + 1).alias("hours")))


def backfill_slots(spark: SparkSession, sf: str) -> DataFrame:
    g = gaps.kline_gaps(market.klines(spark, sf), "5m", 3600, 20 * DAY, NOW)
    return _naive(gaps.backfill_slots(g, 6).select("symbol_id", "exchange", "slot_time", "priority", "slot_key"))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    return aggregates.aggregate_snapshot(t, market.grid(t), OPTIONS).withColumnRenamed("as_of", "snapshot_time")


def overview_page(spark: SparkSession, sf: str) -> DataFrame:
    o = serve.overview(market.symbols(spark, sf), _snapshots(spark, sf), "2024-01-31 00:00:00")
    o = serve.overview_filter(o, exchange="view", rank_from=1)
    return _naive(serve.overview_page(o, "volume", True, ListOptions(limit=12)).select("symbol_id", "symbol", "rank", "snapshot_time", "total_volume_24h", "display_price", "freshness", "total_count"))


def top_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return serve.top_symbols(market.part_symbols(spark, sf), 15).select("symbol_id", "symbol", "rank")


def symbol_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every sold part looked up by its name and by its base asset, which many parts share."""
    sold = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("lookup"))
    lookups = sold.unionByName(sold.select(F.concat(F.lit("b"), F.expr("cast(substring(lookup, 3) as long) % 50").cast("string")).alias("lookup")))
    return serve.resolve_symbols(market.part_symbols(spark, sf), lookups).select("lookup", "symbol_id", "symbol")


def watchlist_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of nations in which a customer lives."""
    w = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("symbol_id"), (F.col("c_custkey") % 3 == 0).alias("is_active"))
    return serve.watched(market.symbols(spark, sf), w).select("symbol_id", "symbol")


def symbol_markets(spark: SparkSession, sf: str) -> DataFrame:
    s = market.part_symbols(spark, sf)
    venues = F.create_map(*[F.lit(x) for x in ("click", " Binance", "view", "okx ", "purchase", "bybit", "signup", "gate", "error", "other")])
    named = s.withColumn("markets", F.to_json(F.transform("markets", lambda m: F.struct(F.element_at(venues, m["exchange"]).alias("exchange"), m["market_type"].alias("market_type"), m["source_symbol"].alias("source_symbol"), m["status"].alias("status")))))
    return payloads.symbol_markets(named)


def series_page(spark: SparkSession, sf: str) -> DataFrame:
    o = ListOptions(symbol_id=3, exchange="view", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", limit=20, offset=10)
    return _naive(serve.list_series(market.ticks(spark, sf), "market", o).select("symbol_id", "exchange", "snapshot_time", "last_price", "total_count"))


def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page deep in the ticks of all symbols, found through days, minutes, seconds and microseconds."""
    o = ListOptions(descending=False, limit=200, offset=700)
    return _naive(serve.page_by_time(market.ticks(spark, sf), "snapshot_time", ["event_id"], o, few=0).select("event_id", "symbol_id", "snapshot_time", "total_count"))


def kline_page(spark: SparkSession, sf: str) -> DataFrame:
    o = ListOptions(symbol_id=4, descending=False, limit=25)
    return _naive(serve.list_series(market.klines(spark, sf), "klines", o).select("symbol_id", "exchange", "open_time", "close_price", "total_count"))


def expire_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, gone = retention.expire(market.ticks(spark, sf), "snapshot_time", "2024-01-15 00:00:00", max_rows=2500, keys=("event_id",))
    return _naive(gone.select("event_id", "symbol_id", "snapshot_time"))


def eligible_count(spark: SparkSession, sf: str) -> DataFrame:
    return retention.eligible_count(market.klines(spark, sf), "open_time", "2024-01-15 00:00:00", "5m")


def rollup_expire(spark: SparkSession, sf: str) -> DataFrame:
    """Candles kept after those before an unaligned cutoff were rolled up and expired."""
    _, kept, _ = retention.rollup_then_expire(market.klines(spark, sf), "5m", "2024-01-15 00:07:00")
    return _naive(kept.select("symbol_id", "exchange", "open_time", "close_price"))


def expired_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Order months and weeks as partition names, some of another table."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    months = o.select(F.date_format("o_orderdate", "'orders_'yyyy_MM").alias("name"))
    year = F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")).cast("string")
    week = F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0")
    weeks = o.select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Orders_").otherwise("sales_"), year, F.lit("_W"), week).alias("name"))
    return retention.expired_partitions(months.unionByName(weeks).distinct(), "1995-06-15", parent="orders")


def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks as heartbeats: a failed k is unhealthy, one in thirteen degraded."""
    t = market.ticks(spark, sf)
    status = F.when(F.col("k") % 17 == 0, "unhealthy").when(F.col("k") % 13 == 0, "degraded").otherwise("healthy")
    return _naive(ops.exchange_health(t.select(F.when(F.col("exchange") != "error", F.col("exchange")).alias("exchange"), F.col("snapshot_time").alias("heartbeat_at"), status.alias("status"))))


def _request_log(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    code = F.when(F.col("k") % 10 == 0, 429).when(F.col("k") % 10 == 1, 503).when(F.col("k") % 10 == 2, None).otherwise(200)
    return t.select("exchange", F.concat(F.lit("type"), (F.col("symbol_id") % 3).cast("string")).alias("request_type"), F.col("snapshot_time").alias("requested_at"), code.alias("status_code"), F.when(F.col("k") % 20 == 2, "timeout").alias("error_type"), F.when(F.col("k") % 10 == 2, F.when(F.col("k") % 20 == 2, "context deadline exceeded").otherwise("connection reset")).alias("error_message"), F.col("last_price").alias("duration_ms"), (F.col("k") % 10 == 0).alias("rate_limited"))


def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ops.request_metrics(_request_log(spark, sf), "2024-01-30 00:00:00", scale=2)


def request_errors(spark: SparkSession, sf: str) -> DataFrame:
    log = ops.classify_requests(_request_log(spark, sf))
    return log.groupBy("exchange", "error_type", "recoverable", "rate_limited").agg(F.count(F.lit(1)).alias("requests"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.status_counts(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderstatus").alias("status")))


def open_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as issues and gaps, sales as clean-up runs."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    i = o.select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    g = o.select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("backfill_status"))
    c = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("rows_deleted"))
    return ops.open_counts(i, g, c)


def upsert_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Candles of each second venue sent again with other prices and volumes: opens stay."""
    k = market.klines(spark, sf).drop("raw_data", "is_closed", "close_time", "trade_count")
    again = k.where("exchange in ('click', 'view')").withColumns({"open_price": F.col("open_price") + 1, "close_price": F.col("close_price") + 1, "volume": F.col("volume") + 2})
    return _naive(sinks.upsert_klines(k, again).withColumns({c: F.round(c, 4) for c in ("open_price", "close_price", "volume")}))


def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Odd events are there already; all events come in."""
    t = market.ticks(spark, sf).select("event_id", "exchange", "last_price")
    return sinks.insert_absent(t.where("event_id % 2 = 1"), t.withColumn("last_price", F.lit(0.0)), ["event_id"])


def normalize_ticker(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.market_snapshots(market.raw_payloads(spark, sf)).groupBy("exchange", "symbol_id").agg(F.count(F.lit(1)).alias("rows"), fn.total("last_price", 2).alias("price_sum"), fn.total("open_interest", 2).alias("oi_sum"), F.max("snapshot_time").alias("newest")))


def normalize_kline(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.klines(market.raw_payloads(spark, sf)).groupBy("exchange", "symbol_id").agg(F.count(F.lit(1)).alias("rows"), fn.total("open_price", 2).alias("open_sum"), fn.total("low_price", 2).alias("low_sum"), fn.total("close_price", 2).alias("close_sum"), fn.total("volume", 2).alias("volume_sum"), F.min("open_time").alias("first_open")))


def orderbook_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.orderbook_imbalances(market.raw_payloads(spark, sf)).select("exchange", "symbol_id", "snapshot_time", *[F.round(c, 4).alias(c) for c in ("bid_notional", "ask_notional", "mid_price", "spread_bps", "imbalance_ratio")]))


def venue_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of each venue spoiled by an error envelope where k is even, counted by what was rejected."""
    raw = market.raw_payloads(spark, sf).where("data_type = 'ticker'")
    bad = F.create_map(*[F.lit(x) for x in ("binance", '{"code":-1121,"msg":"x"}', "okx", '{"code":"50011","msg":"x"}', "bybit", '{"retCode":10006}', "bitget", '{"code":"40034"}', "gate", '{"label":"TOO_FAST"}', "mexc", '{"success":false,"code":510}')])
    raw = raw.withColumn("body", F.when(F.col("symbol_id") % 2 == 0, F.element_at(bad, F.col("exchange"))).otherwise(F.col("body")))
    return payloads.rejected(raw).groupBy("exchange", "error").agg(F.count(F.lit(1)).alias("payloads"))


def health_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Shallow and deep health of ticks whose status is nested for some symbols."""
    t = market.ticks(spark, sf).withColumn("raw_data", F.when(F.col("symbol_id") % 2 == 0, F.concat(F.lit('{"data": {"Quality_Status": " '), F.when(F.col("k") % 17 == 0, "DEGRADED").otherwise("fine"), F.lit(' "}}'))).otherwise(F.col("raw_data")))
    return t.groupBy("symbol_id").agg(F.count_if(~fn.shallow_healthy("raw_data")).alias("shallow_bad"), F.count_if(fn.deep_degraded("raw_data")).alias("deep_bad"))


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    out = streams.latest_values(streams.keyed_events(market.ticks(spark, sf)))
    return _naive(out.select("key", "kind", "symbol_id", "exchange", "snapshot_time", "last_price", "open_interest", "funding_rate"))


def stream_buckets(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    out = streams.bucket_last(streams.keyed_events(market.ticks(spark, sf)).where("kind = 'market'"), bucket="1 hour")
    return _naive(out.select("key", "bucket_time", "snapshot_time", "last_price"))


def stream_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    return _naive(streams.liquidation_buckets(market.liquidations(spark, sf), scale=6))


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    e = market.liquidations(spark, sf)
    return streams.dedupe_events(e.unionByName(e)).groupBy("symbol_id", "exchange").agg(F.count(F.lit(1)).alias("events"))


def stream_lag(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    t = market.ticks(spark, sf).withColumn("received_at", F.col("snapshot_time") + F.make_dt_interval(secs=F.col("k") - 20))
    return _naive(streams.stream_lag(t, "snapshot_time", "received_at", "2024-01-30 00:00:00"))


def fresh_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.streaming import streams

    e = streams.keyed_events(market.ticks(spark, sf)).where("kind = 'market'")
    batch = streams.latest_values(e.where("snapshot_time < timestamp'2024-01-29'"))
    live = streams.live_values(streams.latest_values(e), "2024-01-30 12:00:00", 86_400)
    out = streams.fresh_or_fallback(batch.select("key"), live, batch, "2024-01-30 12:00:00", "last_price", fresh_seconds=43_200)
    return _naive(out)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    venue_asof_latest, latest_ticks, aggregate_snapshot, raw_by_exchange, enrichment, enrichment_book, point_aggregate, market_point_change, window_metrics, anomaly_flags,
    exchange_divergence, venue_candles, kline_rollup, weekly_bars, rollup_probe, market_structure, support_resistance, near_equal_levels, volatility, taker_fill, basis_fill,
    cumulative_delta, liquidation_buckets, liquidation_totals, large_liquidations, derived_open_interest, derived_funding, quarantine_valid, quarantine_issues,
    kline_gaps, stale_latest, stale_sources, coverage_gaps, coverage_runs, backfill_slots, overview_page, top_symbols, symbol_resolve, watchlist_symbols, symbol_markets, series_page, deep_page, kline_page,
    expire_rows, eligible_count, rollup_expire, expired_partitions, health_summary, request_metrics, request_errors, status_counts, open_counts, upsert_klines,
    insert_absent, normalize_ticker, normalize_kline, orderbook_imbalance, venue_errors, health_filters, stream_latest, stream_buckets, stream_liquidations,
    stream_dedupe, stream_lag, fresh_or_fallback,
)

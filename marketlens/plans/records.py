"""Queries of the remaining record types: normalising, quarantine, upserts, lists, keys and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import scalars as fn
from marketlens.operators import aggregates, candles, derive, serve, sinks, validate
from marketlens.options import FlagThresholds, ListOptions, ValidationOptions
from marketlens.plans.market import NOW, OPTIONS, WINDOWS, _naive, _snapshots
from marketlens.sources import market, payloads

Query = Callable[[SparkSession, str], DataFrame]


# ---- payloads ----


def normalize_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.open_interest(market.raw_series(spark, sf)).drop("raw_data", "open_interest_value"))


def normalize_long_short(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.long_short_ratios(market.raw_series(spark, sf)).drop("raw_data"))


def normalize_taker_flow(spark: SparkSession, sf: str) -> DataFrame:
    out = payloads.taker_flows(market.raw_series(spark, sf))
    return _naive(out.select("symbol_id", "exchange", "period", "snapshot_time", "taker_buy_volume", "taker_sell_volume", F.round("buy_sell_delta", 6).alias("buy_sell_delta"), F.round("buy_sell_ratio", 6).alias("buy_sell_ratio")))


def normalize_basis(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(payloads.basis_premiums(market.raw_series(spark, sf)).drop("raw_data", "source_symbol"))


def normalize_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    out = payloads.liquidation_event_buckets(market.raw_series(spark, sf))
    return _naive(out.drop("raw_data", "usd_value").withColumn("notional", F.round("notional", 4)))


# ---- quarantine ----


def _issues(record: str, name: str | None = None, requested_period: str | None = None, requested_symbol: bool = False) -> Query:
    """Rows of each (symbol, venue, type, error) that the rules of a record type reject."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = market.records(spark, sf)
        if not requested_symbol:
            rows = rows.drop("requested_symbol")
        rows = rows.withColumnRenamed("kind", "data_type") if record == "divergence" else rows.drop("kind")
        _, issues = validate.quarantine(rows, record, NOW, ValidationOptions(), requested_period)
        return issues.groupBy("symbol_id", "exchange", "data_type", "issue_type", "error").agg(F.count(F.lit(1)).alias("issues"))

    query.__name__ = name or f"quarantine_{record}"
    return query


QUARANTINES = (
    *[_issues(record) for record in validate.RECORDS], _issues("kline", "quarantine_interval", "1m"), *[_issues(record, f"quarantine_asked_{record}", "\t5m ") for record in validate.ASKED_PERIOD],
    _issues("basis", "quarantine_asked_period_of_none", "1m"), _issues("funding", "quarantine_asked_symbol", requested_symbol=True),
)


# ---- upserts ----


def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of each symbol, venue and hour as a table, then a batch with two rows a key: the later one wins."""
    t = market.ticks(spark, sf)
    hour = fn.time_bucket("snapshot_time", 3600)
    t = t.groupBy("symbol_id", "exchange", hour.alias("hour")).agg(F.max("event_id").alias("event_id"), F.max("last_price").alias("last_price"))
    batch = t.where("event_id % 3 = 0").withColumn("last_price", F.lit(1.0)).withColumn("event_id", F.explode(F.array(F.col("event_id") + 1, F.col("event_id") + 2)))
    return _naive(sinks.upsert(t, batch, ["symbol_id", "exchange", "hour"], order="event_id"))


def upsert_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    """Events sent again at twice the price with another side: the side stays."""
    e = derive.liquidation_usd(market.liquidations(spark, sf)).drop("raw_data")
    again = e.where("cast(event_key as long) % 2 = 0").withColumns({"price": F.col("price") * 2, "usd_value": F.lit(5.0), "side": F.lit("sell")})
    return _naive(sinks.upsert_liquidations(e, again).select("event_key", "symbol_id", "side", "event_time", F.round("price", 4).alias("price"), F.round("usd_value", 4).alias("usd_value")))


def _aggregate_records(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    tables = {"ticks": t, "funding": derive.funding_from_ticks(t), "taker_flow": derive.fill_taker_flow(market.taker_flows(spark, sf)), "basis": market.basis(spark, sf), "orderbook": market.books(spark, sf)}
    tables |= {"cvd": derive.cumulative_delta(market.taker_flows(spark, sf), scale=6), "liquidations": derive.liquidation_buckets(market.liquidations(spark, sf), scale=6).withColumn("raw_data", F.lit("{}"))}
    return aggregates.aggregate_records(tables, market.grid(t, "6 hours"), OPTIONS, FlagThresholds(liquidation_usd=100_000.0, basis_percent=0.5, funding_rate=0.004))


def upsert_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Whole aggregates with their JSON, of which every second symbol's come again with no weighted price and no flags;
    what the JSON holds is read back."""
    r = _aggregate_records(spark, sf)
    # written once: the table and the batch are both made of it
    root = f"{market.shared_folder(spark)}/aggregates-{uuid.uuid4().hex}"
    r.write.parquet(root)
    r = spark.read.schema(r.schema).parquet(root)
    again = r.where("symbol_id % 2 = 0").withColumns({"price_weighted": F.lit(None).cast("double"), "anomaly_flags": F.lit(None).cast("string")})
    out = sinks.upsert_aggregates(r, again)
    flags = F.from_json("anomaly_flags", "array<struct<name string, window string, severity string, value double>>")
    listed = F.array_join(F.transform(flags, lambda f: F.concat_ws("@", f["name"], f["window"])), ",")
    read = lambda c, path, to="double": F.get_json_object(c, path).cast(to)
    return _naive(out.select(
        "symbol_id", "snapshot_time", "exchange_count", "price_avg", "price_weighted", "weighted_price", "total_cvd", "avg_imbalance_percent", "total_bid_depth_usd", "available_exchanges", "raw_by_exchange", "raw_data", "quality_metadata", F.coalesce(listed, F.lit("")).alias("flags"),
        read("window_metrics", "$[0].window", "string").alias("first_window"), read("window_metrics", "$[0].start_time", "string").alias("first_start"), read("window_metrics", "$[2].liquidation_sum_usd").alias("liquidations_24h"), read("metrics", "$.windows[3].basis_avg").alias("basis_7d"), read("metrics", "$.windows[1].quality.current_exchange_count", "long").alias("venues_now"),
    ))


def upsert_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility snapshots with blank labels, of which every second symbol's come again without a range."""
    t = market.ticks(spark, sf)
    v = candles.volatility(candles.venue_candles(market.klines(spark, sf), scale=6), market.grid(t, "6 hours"), WINDOWS, 6)
    label = F.when(F.col("symbol_id") % 3 == 0, "").otherwise("perp")
    v = v.select("symbol_id", F.lit("aggregate").alias("exchange"), label.alias("market_type"), F.lit("").alias("source_symbol"), "period", F.col("as_of").alias("snapshot_time"), "atr", "close_price", F.round("realized_volatility", 6).alias("realized_volatility"), "range_percent_24h", F.when(F.col("candles") > 0, F.concat(F.lit('{"candles": '), F.col("candles").cast("string"), F.lit("}"))).alias("raw_data"))
    return _naive(sinks.upsert_volatility(v, v.where("symbol_id % 2 = 0").withColumn("range_percent_24h", F.lit(None).cast("double"))))


def upsert_market_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Structure snapshots sent again as ranging for every second symbol, with the columns that the table mirrors."""
    t = market.ticks(spark, sf)
    s = candles.market_structure(candles.venue_candles(market.klines(spark, sf), scale=6), market.grid(t, "6 hours"), {"24h": WINDOWS["24h"]})
    s = s.select("symbol_id", F.lit("all").alias("exchange"), "period", F.col("as_of").alias("snapshot_time"), "trend_direction", "structure_state", "last_swing_high", "last_swing_low")
    return _naive(sinks.upsert_market_structure(s, s.where("symbol_id % 2 = 0").withColumn("structure_state", F.lit("ranging"))))


def upsert_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of an hour against the symbol's venue of the first name, mirrored metadata and all."""
    t = market.ticks(spark, sf)
    d = t.groupBy("symbol_id", F.lit("price").alias("data_type"), F.lit("all").alias("reference_exchange"), F.col("exchange").alias("compared_exchange"), fn.time_bucket("snapshot_time", 3600).alias("snapshot_time")).agg(F.max("last_price").alias("price_max"), F.min("last_price").alias("price_min"))
    d = d.withColumn("metadata", F.concat(F.lit('{"low": '), F.format_string("%.2f", "price_min"), F.lit("}")))
    return _naive(sinks.upsert_divergence(d, d.where("compared_exchange = 'view'").withColumns({"price_max": F.lit(0.0), "metadata": F.lit("{}")})))


def upsert_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols and venues as issues, resolved where the symbol is even, seen again at click and view."""
    t = market.ticks(spark, sf)
    i = t.groupBy(F.concat_ws("|", F.col("symbol_id").cast("string"), "exchange").alias("issue_key")).agg(F.min("snapshot_time").alias("first_seen_at"), F.max("snapshot_time").alias("last_seen_at"), F.first("symbol_id").alias("s"), F.first("exchange").alias("x"))
    i = i.withColumn("status", F.when(F.col("s") % 2 == 0, "resolved").otherwise("ignored")).withColumn("severity", F.lit("warning"))
    again = i.where("x in ('click', 'view')").withColumns({"first_seen_at": F.col("last_seen_at") + F.expr("interval 1 day"), "last_seen_at": F.col("last_seen_at") + F.expr("interval 1 day"), "status": F.lit("open"), "severity": F.lit("error")})
    return _naive(sinks.upsert_issues(i.drop("s", "x"), again.drop("s", "x")))


def upsert_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Days between a symbol's ticks as gaps, found again a day later and longer: how the backfill stands is kept."""
    t = market.ticks(spark, sf)
    g = t.groupBy(F.concat_ws("|", F.col("symbol_id").cast("string"), "exchange", F.to_date("snapshot_time").cast("string")).alias("gap_key")).agg(F.min("snapshot_time").alias("gap_start"), F.max("snapshot_time").alias("gap_end"), F.max("event_id").alias("last_event"))
    g = g.withColumn("detected_at", F.col("gap_end")).withColumn("backfill_status", F.when(F.col("last_event") % 2 == 0, "done").otherwise("pending"))
    day = F.expr("interval 1 day")
    again = g.where("last_event % 3 = 0").withColumns({"gap_end": F.col("gap_end") + day, "detected_at": F.col("detected_at") + day, "backfill_status": F.lit("pending")})
    return _naive(sinks.upsert_gaps(g, again))


def upsert_health(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's collector at a venue, with a later heartbeat that knows of an error, of nothing, or of a success."""
    t = market.ticks(spark, sf)
    h = t.groupBy(F.col("symbol_id").cast("string").alias("collector"), "exchange").agg(F.max("snapshot_time").alias("heartbeat_at"), F.min("snapshot_time").alias("last_success_at"))
    h = h.select("collector", "exchange", F.lit("healthy").alias("status"), "heartbeat_at", "last_success_at", F.lit(None).cast("timestamp").alias("last_error_at"), F.lit("old").alias("last_error"))
    kind = F.col("collector").cast("int") % 3
    later = F.col("heartbeat_at") + F.expr("interval 1 minute")
    again = h.withColumns({"status": F.when(kind == 0, "degraded").otherwise("healthy"), "heartbeat_at": later, "last_success_at": F.when(kind == 2, later), "last_error_at": F.when(kind == 0, later), "last_error": F.when(kind == 0, "timeout").otherwise("")})
    return _naive(sinks.upsert_health(h, again))


# ---- keys and lists ----


def liquidation_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The natural key of every event."""
    e = market.liquidations(spark, sf)
    return e.select("event_key", fn.event_key().alias("natural_key"))


def _series(series: str, table: Callable[[SparkSession, str], DataFrame], value: str, options: ListOptions) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        time = serve.SERIES[series][0]
        return _naive(serve.list_series(table(spark, sf), series, options).select("symbol_id", "exchange", F.col(time).alias("moment"), F.round(value, 4).alias("value"), "total_count"))

    query.__name__ = f"{series}_page"
    return query


def _oi_history(spark: SparkSession, sf: str) -> DataFrame:
    return derive.open_interest_from_ticks(market.ticks(spark, sf)).withColumn("timestamp", F.col("snapshot_time")).withColumn("period", F.when(F.col("exchange") == "view", "1h").otherwise("5m"))


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.long_short_ratios(market.raw_series(spark, sf))


def _books(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.orderbook_imbalances(market.raw_payloads(spark, sf))


def _divergence(spark: SparkSession, sf: str) -> DataFrame:
    t = market.ticks(spark, sf)
    return aggregates.exchange_divergence(t, market.grid(t), OPTIONS).withColumnRenamed("as_of", "snapshot_time").withColumn("exchange", F.lit("all"))


def _cvd_5m(spark: SparkSession, sf: str) -> DataFrame:
    return derive.cumulative_delta(market.taker_flows(spark, sf).withColumn("period", F.lit("5m")), scale=6)


SERIES_PAGES = (
    _series("open_interest", lambda s, d: derive.open_interest_from_ticks(market.ticks(s, d)), "open_interest", ListOptions(symbol_id=1, limit=30)),
    _series("open_interest_history", _oi_history, "open_interest", ListOptions(symbol_id=2, period="1h", limit=30, descending=False)),
    _series("funding", lambda s, d: derive.funding_from_ticks(market.ticks(s, d)), "funding_rate", ListOptions(exchange=" VIEW ", limit=40, offset=5)),
    _series("long_short_ratio", _ratios, "long_short_ratio", ListOptions(symbol_id=5, limit=30)),
    _series("taker_flow", market.taker_flows, "taker_buy_volume", ListOptions(period="1h", start="2024-01-10 00:00:00", end="2024-01-12 00:00:00", limit=100)),
    _series("cvd", _cvd_5m, "cvd_value", ListOptions(symbol_id=7, limit=30)),
    _series("liquidations", lambda s, d: derive.liquidation_usd(market.liquidations(s, d)), "usd_value", ListOptions(symbol_id=6, exchange="error", limit=30)),
    _series("basis", market.basis, "basis_percent", ListOptions(symbol_id=8, limit=30)),
    _series("orderbook", _books, "imbalance_ratio", ListOptions(symbol_id=9, start="2024-01-20 00:00:00", limit=30)),
    _series("divergence", _divergence, "price_spread_percent", ListOptions(symbol_id=3, end="2024-01-20 00:00:00", limit=30, offset=100)),
)


def symbol_detail(spark: SparkSession, sf: str) -> DataFrame:
    """A symbol's newest aggregate and the newest rows of each of its series, one under the other."""
    t = market.ticks(spark, sf)
    tables = {
        "klines": (market.klines(spark, sf), "close_price"), "open_interest": (derive.open_interest_from_ticks(t), "open_interest"), "funding": (derive.funding_from_ticks(t), "funding_rate"), "long_short_ratio": (_ratios(spark, sf), "long_short_ratio"),
        "taker_flow": (market.taker_flows(spark, sf).withColumn("period", F.lit("5m")), "taker_buy_volume"), "cvd": (_cvd_5m(spark, sf), "cvd_value"), "liquidations": (derive.liquidation_usd(market.liquidations(spark, sf)), "usd_value"), "basis": (market.basis(spark, sf), "basis_percent"),
        "orderbook": (_books(spark, sf), "imbalance_ratio"), "divergence": (_divergence(spark, sf), "price_spread_percent"), "market": (t, "last_price"),
    }
    parts = serve.symbol_detail(4, _snapshots(spark, sf), {name: df for name, (df, _) in tables.items()}, limit=10)
    row = lambda name, time, value: parts[name].select(F.lit(name).alias("part"), F.col(time).alias("moment"), F.round(value, 4).alias("value"))
    out = row("latest", "snapshot_time", "price_avg")
    for name, (_, value) in tables.items():
        out = out.unionByName(row(name, serve.SERIES[name][0], value))
    return _naive(out)


def admin_page(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs: the urgent ones that are open, newest first."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return _naive(serve.admin_list(o, "created_at", ListOptions(end="1997-06-30 00:00:00", limit=25, offset=10), status="O", priority="1-URGENT").select("id", "symbol_id", "created_at", "total_count"))


# ---- streams ----


def stream_no_future(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of which every fifth k lies a century ahead: those are dropped."""
    from marketlens.streaming import streams

    t = market.ticks(spark, sf).withColumn("snapshot_time", F.when(F.col("k") % 5 == 0, F.col("snapshot_time") + F.expr("interval 100 years")).otherwise(F.col("snapshot_time")))
    return _naive(streams.no_future(t, "snapshot_time").select("event_id", "snapshot_time"))


def stream_running_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The running total of taker deltas, by a stream over the table until it has read all of it."""
    from marketlens.streaming import streams

    events = spark.read.parquet(f"{sf}/events.parquet")
    live = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    flows = derive.fill_taker_flow(market.taker_flows_of(live))
    root = f"{market.shared_folder(spark)}/running-{uuid.uuid4().hex}"
    query = streams.running_delta(flows).writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(streams.RUNNING_DELTA).parquet(f"{root}/rows")
    return _naive(out.withColumns({c: F.round(c, 4) for c in ("cvd_value", "cvd_change")}).drop("cvd_change_percent"))


def _third() -> F.Column:
    """0 to 2: the third of January in which a time lies."""
    return F.least(F.lit(2), F.floor((F.dayofmonth("snapshot_time") - 1) / 10)).cast("int")


def stream_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """Newest ticks of each symbol and venue that live two hours, by a stream in three batches: all sets and expiries."""
    from marketlens.streaming import stateful

    t = market.ticks(spark, sf)
    t = t.select(F.concat_ws(":", "exchange", "source_symbol").alias("key"), "snapshot_time", "last_price")
    root = f"{market.shared_folder(spark)}/expiring-{uuid.uuid4().hex}"
    start = lambda live: stateful.timed_values(live, 7200, late="10 minutes").writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    with stateful.state_on_disk(spark):
        market.in_batches(t, _third(), 3, root, start)
    return _naive(spark.read.schema(stateful.CHANGES).parquet(f"{root}/rows"))


def stream_corrected_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals of taker flows of which every seventh comes a batch late: the newest revisions."""
    from marketlens.streaming import stateful

    f = derive.fill_taker_flow(market.taker_flows(spark, sf).withColumn("_late", F.unix_micros("snapshot_time") % 7 == 0))
    root = f"{market.shared_folder(spark)}/corrected-{uuid.uuid4().hex}"
    start = lambda live: stateful.corrected_delta(live, late="40 days").writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    market.in_batches(f, _third() + F.when(F.col("_late"), 1).otherwise(0), 4, root, start)
    out = stateful.newest_revisions(spark.read.schema(stateful.CORRECTIONS).parquet(f"{root}/rows"))
    return _naive(out.withColumns({c: F.round(c, 4) for c in ("cvd_value", "cvd_change")}))


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A table of each symbol's and venue's newest tick a day, upserted by a stream in four batches of mixed days, of
    which the first is replayed at the end."""
    from marketlens.streaming import epochs

    t = market.ticks(spark, sf).select("symbol_id", "exchange", "snapshot_time", "last_price", F.to_date("snapshot_time").alias("day"))
    root = f"{market.shared_folder(spark)}/upserted-{uuid.uuid4().hex}"
    keys = ["symbol_id", "exchange", "day"]
    newest = lambda old, new: old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct("snapshot_time", "last_price"), "snapshot_time").alias("v")).select("symbol_id", "exchange", "v.*", "day").select(*t.columns)
    batch = F.pmod(F.hour("snapshot_time"), F.lit(4))
    market.in_batches(t, batch, 4, root, lambda live: epochs.upsert_stream(live, f"{root}/table", "day", newest, f"{root}/state"))
    epochs.write_epoch(spark, t.where(batch == 0).withColumn("last_price", F.lit(-1.0)), f"{root}/table", "day", newest, 0)
    return _naive(epochs.read_table(spark, f"{root}/table", t.schema).withColumn("day", F.col("day").cast("string")))


def _mixed(ts_col: str, id_col: str = "event_id") -> F.Column:
    """0 to 2: the third of the month in which a row arrives, up to two hours after its time."""
    hours = (F.unix_seconds(F.col(ts_col).cast("timestamp")) - 1_704_067_200) / 3600  # since 2024-01-01
    return F.least(F.lit(2), F.greatest(F.lit(0), F.floor((hours + F.col(id_col).cast("long") % 3) / 240))).cast("int")


def _appended(spark: SparkSession, df: DataFrame, batch: F.Column, n: int, make) -> DataFrame:
    """Rows of the stream that ``make`` makes of df, met in n batches, in append mode."""
    root = f"{market.shared_folder(spark)}/appended-{uuid.uuid4().hex}"
    schema = make(df.limit(0)).schema
    start = lambda live: make(live).writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    market.in_batches(df, batch, n, root, start)
    return spark.read.schema(schema).parquet(f"{root}/rows")


def stream_latest_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Newest values by key as a stream in three batches updates them, upserted into a table by kind."""
    from marketlens.streaming import epochs, streams

    t = market.ticks(spark, sf)
    root = f"{market.shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    newest = lambda old, new: streams.latest_values(old.unionByName(new))
    market.in_batches(t, _mixed("snapshot_time"), 3, root, lambda live: epochs.upsert_stream(streams.latest_values(streams.keyed_events(live)), f"{root}/table", "kind", newest, f"{root}/state", "update"))
    out = epochs.read_table(spark, f"{root}/table", streams.latest_values(streams.keyed_events(t)).schema)
    return _naive(out.select("key", "kind", "symbol_id", "exchange", "snapshot_time", "last_price", "open_interest", "funding_rate"))


def stream_bucket_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Newest ticks of each hour by a stream in three batches whose rows come up to two hours late: the hours that the
    watermark, six hours behind, has closed."""
    from marketlens.streaming import streams

    make = lambda live: streams.bucket_last(streams.keyed_events(live, ("market",)), bucket="1 hour", late="6 hours")
    return _naive(_appended(spark, market.ticks(spark, sf), _mixed("snapshot_time"), 3, make).select("key", "bucket_time", "snapshot_time", "last_price"))


def stream_liquidation_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Liquidation buckets by a stream in three batches, closed by the watermark."""
    from marketlens.streaming import streams

    make = lambda live: streams.liquidation_buckets(live, late="6 hours", scale=6)
    return _naive(_appended(spark, market.liquidations(spark, sf), _mixed("event_time", "event_key"), 3, make))


def stream_dedupe_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Liquidation events that each come again a batch later: each once."""
    from marketlens.streaming import streams

    e = market.liquidations(spark, sf)
    twice = e.withColumn("_again", F.lit(0)).unionByName(e.withColumn("_again", F.lit(1)))
    out = _appended(spark, twice, _mixed("event_time", "event_key") + F.col("_again"), 4, lambda live: streams.dedupe_events(live, late="40 days"))
    return out.groupBy("symbol_id", "exchange").agg(F.count(F.lit(1)).alias("events"), F.sum("_again").alias("repeats"))


def upsert_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of all days as a partitioned table, of which a second batch rewrites the days that it touches."""
    t = market.ticks(spark, sf).select("event_id", "symbol_id", "last_price", F.to_date("snapshot_time").alias("day"))
    root = f"{market.shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    merge = lambda old, new: sinks.upsert(old, new, ["event_id", "day"])
    sinks.write_partitions(spark, t, f"{root}/table", "day", merge, f"{root}/staging")
    sinks.write_partitions(spark, t.where("dayofmonth(day) % 5 = 0 and event_id % 2 = 0").withColumn("last_price", -F.col("last_price")), f"{root}/table", "day", merge, f"{root}/staging")
    return spark.read.schema(t.schema).parquet(f"{root}/table").withColumn("day", F.col("day").cast("string"))


def audited_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads read from lines of which some are torn and some come again: each once, with why it is kept and its hash."""
    e = market.events(spark, sf)
    k = F.col("k")
    venue = F.element_at(F.array(*[F.lit(f" {v.upper()}") for v in payloads.VENUES]), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.when(k % 13 == 0, '{"code": -1121}').when(k % 7 == 0, "gone").otherwise(F.format_string('{"k": %d}', k))
    line = F.to_json(F.struct(venue.alias("exchange"), F.lit("ticker").alias("data_type"), F.when(k % 3 != 0, F.concat(F.lit("S"), "symbol_id")).alias("source_symbol"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("payload_time"), body.alias("payload")))
    lines = e.select("event_id", F.when(k % 11 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))
    root = f"{market.shared_folder(spark)}/payloads-{uuid.uuid4().hex}"
    lines.unionByName(lines.where("event_id % 4 = 0")).select("value").write.text(f"{root}/lines")
    return _naive(payloads.audited(payloads.read_lines(spark, f"{root}/lines")))


def bucket_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Liquidation buckets of one minute, as for symbols outside the widest tier."""
    return _naive(derive.liquidation_buckets(market.liquidations(spark, sf), tier="top", scale=6).select("symbol_id", "exchange", "bucket_time", "period", "long_liquidation_count", "short_liquidation_count", "total_liquidation_usd"))


QUERIES: tuple[Query, ...] = (
    normalize_open_interest, normalize_long_short, normalize_taker_flow, normalize_basis, normalize_liquidations, *QUARANTINES, upsert_rows, upsert_liquidations, upsert_aggregates, upsert_volatility, upsert_market_structure, upsert_divergence,
    upsert_issues, upsert_gaps, upsert_health, liquidation_keys, *SERIES_PAGES, symbol_detail, admin_page, stream_no_future, stream_running_delta, bucket_volume, stream_expiring, stream_corrected_delta, stream_upsert, stream_latest_batches, stream_bucket_batches, stream_liquidation_batches, stream_dedupe_batches, upsert_partitions, audited_payloads,
)

"""The driver's tables seen as market facts, so that every operator runs on given data and grows with it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources.payloads import _once


#: Measures of the records that get a negative value in turn.
MEASURES = (
    "last_price", "mark_price", "index_price", "bid_price", "ask_price", "volume_24h", "quote_volume_24h", "open_interest", "open_interest_value", "open_price", "high_price", "low_price", "close_price", "volume", "quote_volume",
    "taker_buy_volume", "taker_sell_volume", "taker_buy_quote_volume", "taker_sell_quote_volume", "price", "quantity", "notional", "usd_value", "futures_price", "spot_price", "mid_price", "spread_bps", "bid_notional", "ask_notional",
    "bid_depth_usd", "ask_depth_usd", *[f"{side}_depth_{p}pct_usd" for p in (1, 2, 5) for side in ("bid", "ask")], *[f"{side}_liquidation_{unit}" for side in ("long", "short", "total") for unit in ("usd", "notional")], "largest_liquidation_usd",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, symbol_id, exchange, value and k of each event."""
    return _events(spark, sf_dir)


def _facts(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("symbol_id"), F.col("event_type").alias("exchange"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def _source_symbol():
    return F.concat(F.lit("S"), F.col("symbol_id").cast("string")).alias("source_symbol")


def _raw():
    return F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "status": "'), F.when(F.col("k") % 17 == 0, "failed").otherwise("ok"), F.lit('"}')).alias("raw_data")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market snapshots: one an event, its venue the event's type; every seventeenth k is marked failed."""
    none = F.lit(None).cast("double")
    return _events(spark, sf_dir).select("symbol_id", "exchange", _source_symbol(), F.col("ts").alias("snapshot_time"), F.col("value").alias("last_price"), none.alias("mark_price"), none.alias("index_price"), (F.col("value") * 2).alias("volume_24h"), (F.col("value") * 3).alias("quote_volume_24h"), F.col("k").cast("double").alias("open_interest"), ((F.col("k") - 50) / F.lit(10000.0)).alias("funding_rate"), _raw(), "k", "event_id")


def taker_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups buy, the rest sells."""
    return taker_flows_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def taker_flows_of(events: DataFrame) -> DataFrame:
    """The same of a table or a stream of events."""
    buys = F.col("exchange").isin("purchase", "signup")
    none = F.lit(None).cast("double")
    e = _facts(events)
    return e.select("symbol_id", "exchange", _source_symbol(), F.lit("1h").alias("period"), F.col("ts").alias("snapshot_time"), F.when(buys, F.col("value")).otherwise(0.0).alias("taker_buy_volume"), F.when(buys, 0.0).otherwise(F.col("value")).alias("taker_sell_volume"), none.alias("taker_buy_quote_volume"), none.alias("taker_sell_quote_volume"), none.alias("buy_sell_delta"), none.alias("buy_sell_delta_quote"), none.alias("buy_sell_ratio"), _raw())


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("exchange") == "purchase", "long").when(F.col("exchange") == "error", "short").otherwise("unknown")
    none = F.lit(None).cast("double")
    return _events(spark, sf_dir).select("symbol_id", "exchange", _source_symbol(), F.col("event_id").cast("string").alias("event_key"), F.col("ts").alias("event_time"), side.alias("side"), F.col("value").alias("price"), (F.col("k") + 1).cast("double").alias("quantity"), none.alias("notional"), none.alias("usd_value"), _raw())


def basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return _events(spark, sf_dir).select("symbol_id", "exchange", _source_symbol(), F.col("ts").alias("snapshot_time"), (F.col("value") + F.col("k")).alias("futures_price"), F.col("value").alias("index_price"), none.alias("basis"), none.alias("basis_value"), ((F.col("k") - 50) / F.lit(20.0)).alias("basis_percent"), _raw())


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order book snapshots, one an event; a ninth k has a negative bid depth."""
    k, value = F.col("k"), F.col("value")
    return _events(spark, sf_dir).select("symbol_id", "exchange", _source_symbol(), F.col("ts").alias("snapshot_time"), F.lit(10).alias("depth_levels"), ((k - 50) * F.lit(3.0)).alias("imbalance_percent"), F.when(k == 9, -value).otherwise(value * 10).alias("bid_depth_usd"), (value * 7).alias("ask_depth_usd"), _raw())


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute candles of the events of each symbol and venue; a venue's open and close are its first and last event."""
    e = _events(spark, sf_dir)
    at = F.struct("ts", "event_id")
    bucket = F.timestamp_seconds(F.floor(F.unix_micros("ts") / 300_000_000) * 300)
    k = e.groupBy("symbol_id", "exchange", bucket.alias("open_time")).agg(F.max("ts").alias("close_time"), F.min_by("value", at).alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"), F.max_by("value", at).alias("close_price"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"), F.sum((F.col("value") * 3).cast("decimal(18,2)")).cast("double").alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"), F.max("k").alias("k"))
    return k.select("symbol_id", "exchange", _source_symbol(), F.lit("5m").alias("interval"), "open_time", "close_time", "open_price", "high_price", "low_price", "close_price", "volume", "quote_volume", "trade_count", F.lit(True).alias("is_closed"), _raw())


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as daily bars: supplier is the symbol, flag and status the venue, price per unit the price."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    return item.select(F.col("l_suppkey").alias("symbol_id"), F.concat("l_returnflag", "l_linestatus").alias("exchange"), F.col("l_shipdate").cast("timestamp").alias("open_time"), "l_orderkey", "l_partkey", "l_linenumber", price, F.col("l_quantity").alias("volume"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as symbols: rank is the key, every seventh is inactive, markets are the event types."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    venues = ("click", "view", "purchase", "signup", "error")
    market = lambda v: F.struct(F.lit(v).alias("exchange"), F.lit("perp").alias("market_type"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source_symbol"), F.lit("active").alias("status"))
    s = n.join(r, n.n_regionkey == r.r_regionkey)
    return s.select(F.col("n_nationkey").cast("long").alias("symbol_id"), F.col("n_name").alias("symbol"), F.substring("n_name", 1, 3).alias("base_asset"), F.col("r_name").alias("quote_asset"), F.when(F.col("n_nationkey") != 13, F.col("n_nationkey").cast("int")).alias("rank"), (F.col("n_nationkey") % 7 != 0).alias("is_active"), F.slice(F.array(*[market(v) for v in venues]), 1, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("markets"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols, a dimension that grows with the data: rank by key, some without, every seventh inactive."""
    key = F.col("p_partkey")
    venues = ("click", "view", "purchase", "signup", "error")
    market = lambda v: F.struct(F.lit(v).alias("exchange"), F.lit("perp").alias("market_type"), F.concat(F.lit("S"), key.cast("string")).alias("source_symbol"), F.lit("active").alias("status"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(key.cast("long").alias("symbol_id"), F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.concat(F.lit("B"), (key % 50).cast("string")).alias("base_asset"), F.when(key % 13 != 0, (key % 1000).cast("int")).alias("rank"), (key % 7 != 0).alias("is_active"), F.slice(F.array(*[market(v) for v in venues]), 1, (key % 5 + 1).cast("int")).alias("markets"))


def grid(ticks: DataFrame, step: str = "1 hour") -> DataFrame:
    """Instants of each symbol: every step from the second day of its ticks to its last tick."""
    b = ticks.groupBy("symbol_id").agg(F.min("snapshot_time").alias("lo"), F.max("snapshot_time").alias("hi"))
    first = F.date_trunc("day", "lo") + F.expr("interval 1 day")
    return b.where(first <= F.col("hi")).select("symbol_id", F.explode(F.sequence(first, F.col("hi"), F.expr(f"interval {step}"))).alias("as_of"))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue payloads in six formats, made from the events: tickers, order books and candles."""
    e = _events(spark, sf_dir).withColumn("venue", F.element_at(F.array(*[F.lit(v) for v in ("binance", "okx", "bybit", "bitget", "gate", "mexc")]), (F.col("event_id") % 6 + 1).cast("int")))
    v, k, ms = F.col("value").cast("string"), F.col("k").cast("string"), F.unix_millis("ts").cast("string")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    ticker = (
        F.when(F.col("venue") == "binance", s('{"symbol":"S","lastPrice":"', v, '","openInterest":"', k, '","time":', ms, "}"))
        .when(F.col("venue") == "okx", s('{"code":"0","data":[{"instId":"S","last":"', v, '","oi":"', k, '","ts":"', ms, '"}]}'))
        .when(F.col("venue") == "bybit", s('{"retCode":0,"time":', ms, ',"result":{"list":[{"symbol":"S","lastPrice":"', v, '","openInterest":"', k, '"}]}}'))
        .when(F.col("venue") == "bitget", s('{"code":"00000","requestTime":', ms, ',"data":[{"symbol":"S","lastPr":"', v, '","openInterest":"', k, '"}]}'))
        .when(F.col("venue") == "gate", s('[{"contract":"S","last":"', v, '","total_size":"', k, '"}]'))
        .otherwise(s('{"success":true,"code":0,"data":{"symbol":"S","lastPrice":', v, ',"holdVol":', k, ',"timestamp":', ms, "}}"))
    )
    bids, asks = s('[["', v, '","', k, '"],["', v, '","1"]]'), s('[["', (F.col("value") + 1).cast("string"), '","2"]]')
    book = (
        F.when(F.col("venue").isin("binance", "gate"), s('{"bids":', bids, ',"asks":', asks, "}"))
        .when(F.col("venue") == "okx", s('{"code":"0","data":[{"bids":', bids, ',"asks":', asks, "}]}"))
        .when(F.col("venue") == "bybit", s('{"retCode":0,"result":{"b":', bids, ',"a":', asks, "}}"))
        .when(F.col("venue") == "bitget", s('{"code":"00000","data":[{"bids":', bids, ',"asks":', asks, "}]}"))
        .otherwise(s('{"success":true,"data":{"bids":', bids, ',"asks":', asks, "}}"))
    )
    sec = F.floor(F.unix_millis("ts") / 1000).cast("string")
    row = s('["', ms, '","', v, '","', v, '","1.5","', v, '","', k, '","7","8"]')
    candles = (
        F.when(F.col("venue") == "binance", s("[[", ms, ',"', v, '","', v, '","1.5","', v, '","', k, '",', ms, ',"8","3","1","2"]]'))
        .when(F.col("venue") == "okx", s('{"code":"0","data":[', row, "]}"))
        .when(F.col("venue") == "bybit", s('{"retCode":0,"result":{"list":[', row, "]}}"))
        .when(F.col("venue") == "bitget", s('{"code":"00000","data":[', row, "]}"))
        .when(F.col("venue") == "gate", s('[["', sec, '","', k, '","', v, '","', v, '","1.5","', v, '"]]'))
        .otherwise(s('{"success":true,"data":{"time":[', sec, '],"open":[', v, '],"high":[', v, '],"low":[1.5],"close":[', v, '],"vol":[', k, "]}}"))
    )
    kinds = F.array(*[F.struct(F.lit(t).alias("data_type"), b.alias("body")) for t, b in (("ticker", ticker), ("orderbook", book), ("kline", candles))])
    e = e.select(F.col("venue").alias("exchange"), "symbol_id", F.lit("S").alias("source_symbol"), F.lit("5m").alias("period"), F.col("ts").alias("captured_at"), F.explode(kinds).alias("x"))
    return e.select("exchange", "x.data_type", "symbol_id", "source_symbol", "period", "captured_at", "x.body")


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the remaining record types in the formats of the venues that offer them, made from the events; a
    venue's name comes in capitals now and then."""
    e = _events(spark, sf_dir).withColumn("venue", F.element_at(F.array(*[F.lit(v) for v in ("binance", "okx", "bybit", "bitget", "gate", "mexc")]), (F.col("event_id") % 6 + 1).cast("int")))
    v, k, ms = F.col("value").cast("string"), F.col("k").cast("string"), F.unix_millis("ts").cast("string")
    sec = F.floor(F.unix_millis("ts") / 1000).cast("string")
    odd = lambda a, b: F.when(F.col("k") % 2 == 1, a).otherwise(b)

    def body(**venues):
        out = None
        for venue, text in venues.items():
            given = {"v": v, "k": k, "ms": ms, "sec": sec, "sell": odd("SELL", "BUY"), "pos": odd("long", "short"), "sign": odd("", "-")}
            parts = [given.get(p, F.lit(p)) for p in text.split("%")]
            out = (F if out is None else out).when(F.col("venue") == venue, F.concat(*parts))
        return out

    kinds = {
        "open_interest": body(binance='{"openInterest":"%k%","time":%ms%}', okx='{"code":"0","data":[{"oi":"%k%","ts":"%ms%"}]}', bybit='{"retCode":0,"result":{"list":[{"openInterest":"%k%","timestamp":"%ms%"}]}}', bitget='{"code":"00000","data":[{"openInterest":"%k%","ts":"%ms%"}]}', gate='[[%sec%,"%k%"],[%sec%,null]]', mexc='{"success":true,"data":{"holdVol":%k%,"timestamp":%ms%}}'),
        "long_short_ratio": body(binance='[{"timestamp":%ms%,"longAccount":"%v%","shortAccount":"%k%","longShortRatio":"1.5"}]', okx='{"code":"0","data":[["%ms%","%v%","%k%"]]}', bybit='{"retCode":0,"result":{"list":[{"timestamp":"%ms%","buyRatio":"%v%","sellRatio":"%k%"}]}}', bitget='{"code":"00000","data":[{"ts":"%ms%","longRatio":"%v%","shortRatio":"%k%"}]}', gate='[[%sec%,"0","0","%v%","%k%"]]'),
        "taker_flow": body(binance='[{"timestamp":%ms%,"buyVol":"%v%","sellVol":"%k%"}]', okx='{"code":"0","data":[["%ms%","%k%","%v%"]]}', gate='[[%sec%,"0","0","0","0","%v%","%k%"]]'),
        "basis": body(binance='[{"timestamp":%ms%,"futuresPrice":"%v%","indexPrice":"%k%","basis":"2.5","basisRate":"0.25"}]', gate='[[%sec%,"0","%k%"]]'),
        "liquidation": body(binance='[{"time":%ms%,"price":"%v%","origQty":"%k%","side":"%sell%"}]', okx='{"code":"0","data":[{"ts":"%ms%","bkPx":"%v%","sz":"%k%","posSide":"%pos%"}]}', bybit='{"retCode":0,"result":{"list":[{"timestamp":"%ms%","price":"%v%","size":"%k%","side":"%sell%"}]}}', gate='[{"time":%sec%,"price":"%v%","size":%sign%%k%}]', mexc='{"success":true,"data":{"items":[{"time":%sec%,"price":"%v%","qty":%k%,"side":"%pos%"}]}}'),
    }
    each = F.array(*[F.struct(F.lit(t).alias("data_type"), b.alias("body")) for t, b in kinds.items()])
    name = F.when(F.col("k") % 10 == 0, F.upper("venue")).otherwise(F.col("venue"))
    e = e.select(name.alias("exchange"), "symbol_id", F.lit("S").alias("source_symbol"), F.lit("5m").alias("period"), F.col("ts").alias("captured_at"), F.explode(each).alias("x")).where("x.body is not null")
    return e.select("exchange", "x.data_type", "symbol_id", "source_symbol", "period", "captured_at", "x.body")


def in_batches(df: DataFrame, batch, n: int, root: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let a stream meet the rows of df batch by batch (``batch``: a column of 0 to n - 1): the files of each are written,
    then the query that ``start`` makes of the stream reads what is new, from where its checkpoint says it was."""
    for k in range(n):
        df.where(batch == k).write.parquet(f"{root}/in/{k}")
        live = df.sparkSession.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        start(live).awaitTermination()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event with the columns of all record types and faults by k: no venue (3), in the future (5), no time
    (6), a wrong unit (11), no period (12), no levels (14), a blank label (15), a wild rate (17), and, for one k in ten,
    one negative measure, each in its turn. What was asked for is the symbol (with white space, in another case, nothing,
    or as it is)."""
    k = F.col("k")
    e = _once(_events(spark, sf_dir), k=k)
    # an event without k has no fault
    at = F.when(k == 5, F.col("ts") + F.expr("interval 400 days")).when(~k.eqNullSafe(6), F.col("ts"))
    period = F.when(k == 11, "5 minutes").when(~k.eqNullSafe(12), " 5m ")
    label = F.when(~k.eqNullSafe(15), F.lit("sell"))
    # a fault is negative whatever the value, also where that is zero or no number; no other measure is
    measure = lambda n: F.when((k % 10 == 9) & (F.col("event_id") % len(MEASURES) == n), -1.0).otherwise(F.abs("value"))
    times = ("snapshot_time", "open_time", "funding_time", "event_time", "bucket_time")
    symbol = F.concat(F.lit("S"), F.col("symbol_id").cast("string"))
    asked = F.when(F.col("symbol_id") == 1, F.concat(F.lit(" "), symbol, F.lit("\t"))).when(F.col("symbol_id") == 2, F.lower(symbol)).when(F.col("symbol_id") == 3, " ").otherwise(symbol)
    return e.select("event_id", "symbol_id", F.when(k == 3, " ").otherwise(F.col("exchange")).alias("exchange"), _source_symbol(), asked.alias("requested_symbol"), *[at.alias(c) for c in times], F.col("ts").alias("close_time"), period.alias("period"), F.trim(period).alias("interval"), label.alias("side"), label.alias("kind"), F.when(k == 17, -0.25).otherwise((k - 50) / F.lit(10000.0)).alias("funding_rate"), F.when(k == 14, 0).otherwise(10).alias("depth_levels"), *[measure(n).alias(c) for n, c in enumerate(MEASURES)])

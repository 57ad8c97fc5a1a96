"""Raw venue payloads as typed market facts: one Spark job per record type, for all venues at once.

Input: a table of raw payloads (exchange, data_type, symbol_id, source_symbol, period, captured_at, body). Each record
type has a table of where a venue keeps its rows and fields; a payload's rows are exploded, and each canonical column
is one expression over the venues. Payloads that a venue marked as an error are left out here and kept by ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.scalars import from_epoch_ms, from_epoch_s, number, text, time_bucket

VENUES = ("binance", "okx", "bybit", "bitget", "gate", "mexc")
RAW_SCHEMA = "exchange string, data_type string, symbol_id long, source_symbol string, period string, captured_at timestamp, body string"

# The venues' payload formats. Where rows lie in a payload, and the place of each field in a row.
_TICKER_ROWS = {"binance": "$", "okx": "$.data[0]", "bybit": "$.result.list[0]", "bitget": "$.data[0]", "gate": "$[0]", "mexc": "$.data[0]"}
_TICKER = {
    "last_price": {"binance": "lastPrice", "okx": "last", "bybit": "lastPrice", "bitget": "lastPr", "gate": "last", "mexc": "lastPrice"},
    "mark_price": {"binance": "markPrice", "okx": "markPx", "bybit": "markPrice", "bitget": "markPrice", "gate": "mark_price", "mexc": "fairPrice"},
    "index_price": {"binance": "indexPrice", "okx": "idxPx", "bybit": "indexPrice", "bitget": "indexPrice", "gate": "index_price", "mexc": "indexPrice"},
    "bid_price": {"binance": "bidPrice", "okx": "bidPx", "bybit": "bid1Price", "bitget": "bidPr", "gate": "highest_bid", "mexc": "bid1"},
    "ask_price": {"binance": "askPrice", "okx": "askPx", "bybit": "ask1Price", "bitget": "askPr", "gate": "lowest_ask", "mexc": "ask1"},
    "volume_24h": {"binance": "volume", "okx": "vol24h", "bybit": "volume24h", "bitget": "baseVolume", "gate": "volume_24h_base", "mexc": "volume24"},
    "quote_volume_24h": {"binance": "quoteVolume", "okx": "volCcy24h", "bybit": "turnover24h", "bitget": "quoteVolume", "gate": "volume_24h_quote", "mexc": "amount24"},
    "price_change_percent_24h": {"binance": "priceChangePercent", "okx": "change24h", "bybit": "price24hPcnt", "bitget": "change24h", "gate": "change_percentage"},
    "open_interest": {"binance": "openInterest", "okx": "oi", "bybit": "openInterest", "bitget": "openInterest", "gate": "total_size", "mexc": "holdVol"},
    "funding_rate": {"binance": "lastFundingRate", "okx": "fundingRate", "bybit": "fundingRate", "bitget": "fundingRate", "gate": "funding_rate", "mexc": "fundingRate"},
}
_LIST_ROWS = {"binance": "$", "okx": "$.data", "bybit": "$.result.list", "bitget": "$.data", "gate": "$", "mexc": "$.data"}
_KLINE = {
    "open_price": {"binance": 1, "okx": 1, "bybit": 1, "bitget": 1, "gate": 5},
    "high_price": {"binance": 2, "okx": 2, "bybit": 2, "bitget": 2, "gate": 3},
    "low_price": {"binance": 3, "okx": 3, "bybit": 3, "bitget": 3, "gate": 4},
    "close_price": {"binance": 4, "okx": 4, "bybit": 4, "bitget": 4, "gate": 2},
    "volume": {"binance": 5, "okx": 5, "bybit": 5, "bitget": 5, "gate": 1},
    "quote_volume": {"binance": 7, "okx": 7, "bybit": 6, "bitget": 6},
    "trade_count": {"binance": 8},
    "taker_buy_volume": {"binance": 9},
    "taker_buy_quote_volume": {"binance": 10},
}
_OPEN_INTEREST = {"binance": "openInterest", "okx": "oi", "bybit": "openInterest", "bitget": "openInterest", "gate": 1, "mexc": "holdVol"}
_OPEN_INTEREST_TIME = {"binance": "time", "okx": "ts", "bybit": "timestamp", "bitget": "ts", "gate": 0, "mexc": "timestamp"}
_RATIO_TIME = {"binance": "timestamp", "okx": 0, "bybit": "timestamp", "bitget": "ts", "gate": 0}
_RATIO_LONG = {"binance": "longAccount", "okx": 1, "bybit": "buyRatio", "bitget": "longRatio", "gate": 3}
_RATIO_SHORT = {"binance": "shortAccount", "okx": 2, "bybit": "sellRatio", "bitget": "shortRatio", "gate": 4}
_TAKER_TIME = {"binance": "timestamp", "okx": 0, "gate": 0}
_TAKER_BUY = {"binance": "buyVol", "okx": 2, "gate": 5}
_TAKER_SELL = {"binance": "sellVol", "okx": 1, "gate": 6}
_BOOK_ROWS = {"binance": "$", "okx": "$.data[0]", "bybit": "$.result", "bitget": "$.data[0]", "gate": "$", "mexc": "$.data"}
_BOOK_BIDS = {"binance": "bids", "okx": "bids", "bybit": "b", "bitget": "bids", "gate": "bids", "mexc": "bids"}
_BOOK_ASKS = {"binance": "asks", "okx": "asks", "bybit": "a", "bitget": "asks", "gate": "asks", "mexc": "asks"}
_LIQUIDATION_ROWS = {"binance": "$", "okx": "$.data", "bybit": "$.result.list", "gate": "$", "mexc": "$.data.items"}
_LIQUIDATION_TIME = {"binance": "time", "okx": "ts", "bybit": "timestamp", "gate": "time", "mexc": "time"}
_LIQUIDATION_PRICE = {"binance": "price", "okx": "bkPx", "bybit": "price", "gate": "price", "mexc": "price"}
_LIQUIDATION_SIZE = {"binance": "origQty", "okx": "sz", "bybit": "size", "gate": "size", "mexc": "qty"}
_LIQUIDATION_SIDE = {"binance": "side", "okx": "posSide", "bybit": "side", "mexc": "side"}
#: Venues whose rows count in seconds.
_SECONDS = ("gate",)


def _path(place) -> str:
    return f"$[{place}]" if isinstance(place, int) else f"$.{place}"


def _by_venue(places: dict, make) -> Column:
    """One expression that picks the venue's; null for venues without one."""
    out = None
    for venue, place in places.items():
        value = make(venue, place)
        out = F.when(F.col("exchange") == venue, value) if out is None else out.when(F.col("exchange") == venue, value)
    return out


def _json(source: str, places: dict) -> Column:
    return _by_venue(places, lambda _, p: F.get_json_object(source, p if str(p).startswith("$") else _path(p)))


def _field(places: dict) -> Column:
    return number(_json("row", places))


def _time(places: dict) -> Column:
    return _by_venue(places, lambda v, p: (from_epoch_s if v in _SECONDS else from_epoch_ms)(F.get_json_object("row", _path(p))))


def venue_error() -> Column:
    """What a venue's envelope says went wrong, or null."""
    get = lambda p: F.get_json_object("body", p)
    code = get("$.code")
    return (
        F.when(F.try_parse_json("body").isNull(), "malformed payload")
        .when((F.col("exchange") == "binance") & code.isNotNull(), F.concat(F.lit("code "), code))
        .when((F.col("exchange") == "okx") & (F.coalesce(code, F.lit("0")) != "0"), F.concat(F.lit("code "), code))
        .when((F.col("exchange") == "bybit") & (F.coalesce(get("$.retCode"), F.lit("0")) != "0"), F.concat(F.lit("code "), get("$.retCode")))
        .when((F.col("exchange") == "bitget") & ~F.coalesce(code, F.lit("")).isin("", "00000"), F.concat(F.lit("code "), code))
        .when((F.col("exchange") == "gate") & (F.coalesce(get("$.label"), F.lit("")) != ""), F.concat(F.lit("label "), get("$.label")))
        .when((F.col("exchange") == "mexc") & (F.coalesce(get("$.success"), F.lit("false")) != "true"), F.concat(F.lit("code "), F.coalesce(code, F.lit(""))))
    )


#: Columns of the audit table before its own ones.
LINES = "exchange string, data_type string, source_symbol string, payload_time timestamp, payload string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Captured payloads of a folder of JSON lines. A line that can't be read is kept whole, as ``torn``."""
    return spark.read.schema(f"{LINES}, torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "torn").json(path)


def audited(lines: DataFrame) -> DataFrame:
    """The audit table: each payload once, with its hash and why it is kept: ``failed_job`` for a torn line (the line is
    the payload), ``quality_issue`` for what is no JSON or a venue's error, else ``audit``. Payloads are the same when
    venue, type, symbol (null is blank), time and hash are."""
    torn = F.col("torn").isNotNull()
    named = _named(lines).withColumn("body", F.col("payload"))
    reason = F.when(torn, "failed_job").when(F.col("body").isNull() | venue_error().isNotNull(), "quality_issue").otherwise("audit")
    rows = named.select(*[F.when(~torn, F.col(c)).alias(c) for c in ("exchange", "data_type", "source_symbol", "payload_time")], F.coalesce("torn", "payload").alias("payload"), reason.alias("capture_reason"))
    rows = rows.withColumn("payload_hash", F.sha2(F.coalesce("payload", F.lit("")), 256))
    identity = ["exchange", "data_type", F.coalesce("source_symbol", F.lit("")).alias("_symbol"), "payload_time", "payload_hash"]
    return rows.groupBy(*identity).agg(F.min("source_symbol").alias("source_symbol"), F.min("payload").alias("payload"), F.min("capture_reason").alias("capture_reason"), F.count(F.lit(1)).alias("captures")).drop("_symbol")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns (new, or in the place of old ones) that are worked out once a row: as the one row of a generator
    they are not pasted into every expression above that reads them."""
    kept = [c for c in df.columns if c not in columns]
    out = df.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))
    return out.select(*df.columns, *[name for name in columns if name not in df.columns])


def _named(raw: DataFrame) -> DataFrame:
    """Venue names trimmed and in lower case, before anything is compared with them."""
    return _once(raw, exchange=F.lower(F.trim("exchange")))


def rejected(raw: DataFrame) -> DataFrame:
    """Payloads that a venue marked as an error, with the error."""
    return _named(raw).withColumn("error", venue_error()).where(F.col("error").isNotNull())


def _accepted(raw: DataFrame, *types: str) -> DataFrame:
    return _named(raw).where(F.col("data_type").isin(*types) & venue_error().isNull())


def _one(raw: DataFrame, rows: dict, *types: str) -> DataFrame:
    """Payloads of one row each; a list or a single object both serve."""
    plain = {v: p.removesuffix("[0]") for v, p in rows.items()}
    first = F.coalesce(_json("body", rows), F.when(~F.coalesce(_json("body", plain), F.lit("[")).startswith("["), _json("body", plain)))
    return _once(_accepted(raw, *types), row=first).where("row is not null")


def _many(raw: DataFrame, rows: dict, *types: str) -> DataFrame:
    listed = F.from_json(_json("body", rows), "array<string>")
    return _accepted(raw, *types).withColumn("row", F.explode(listed))


_META = ("symbol_id", "exchange", "source_symbol")


def market_snapshots(raw: DataFrame) -> DataFrame:
    d = _one(raw, _TICKER_ROWS, "ticker", "mark_price", "index_price", "funding", "open_interest_ticker")
    ms = lambda source, p: from_epoch_ms(F.get_json_object(source, p))
    at = (
        F.when(F.col("exchange") == "binance", F.coalesce(ms("row", "$.time"), ms("row", "$.closeTime")))
        .when(F.col("exchange") == "okx", ms("row", "$.ts"))
        .when(F.col("exchange") == "bybit", ms("body", "$.time"))
        .when(F.col("exchange") == "bitget", ms("body", "$.requestTime"))
        .when(F.col("exchange") == "mexc", ms("row", "$.timestamp"))
    )
    return d.select(*_META, "data_type", F.coalesce(at, "captured_at").alias("snapshot_time"), *[_field(p).alias(c) for c, p in _TICKER.items()], F.col("body").alias("raw_data"))


def klines(raw: DataFrame) -> DataFrame:
    rows = {v: p for v, p in _LIST_ROWS.items() if v != "mexc"}
    d = _many(raw, rows, "kline")
    opened = _time({v: 0 for v in rows})
    closed = F.when(F.col("exchange") == "binance", from_epoch_ms(F.get_json_object("row", "$[6]"))).otherwise(opened)
    confirm = F.when(F.col("exchange") == "binance", F.get_json_object("row", "$[11]") != "false").when(F.col("exchange") == "okx", F.get_json_object("row", "$[8]").isin("1", "1.0"))
    lists = d.select(*_META, F.col("period").alias("interval"), opened.alias("open_time"), closed.alias("close_time"), *[_field(p).alias(c) for c, p in _KLINE.items()], F.coalesce(confirm, F.lit(True)).alias("is_closed"), F.col("row").alias("raw_data"))
    # mexc gives one array a column; rows with a missing value are left out
    m = _accepted(raw, "kline").where("exchange = 'mexc'").withColumn("c", F.from_json(F.get_json_object("body", "$.data"), "struct<time:array<long>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,vol:array<double>>"))
    m = m.select(*_META, F.col("period").alias("interval"), F.explode(F.arrays_zip("c.time", "c.open", "c.high", "c.low", "c.close", "c.vol")).alias("r")).where("r.time is not null and r.open is not null and r.high is not null and r.low is not null and r.close is not null and r.vol is not null")
    t, none = F.timestamp_seconds("r.time"), F.lit(None).cast("double")
    m = m.select(*_META, "interval", t.alias("open_time"), (t + F.expr("interval 1 minute")).alias("close_time"), F.col("r.open").alias("open_price"), F.col("r.high").alias("high_price"), F.col("r.low").alias("low_price"), F.col("r.close").alias("close_price"), F.col("r.vol").alias("volume"), *[none.alias(c) for c in ("quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")], F.lit(True).alias("is_closed"), F.to_json("r").alias("raw_data"))
    out = lists.unionByName(m).withColumn("trade_count", F.col("trade_count").cast("long"))
    return out.fillna(0.0, ["open_price", "high_price", "low_price", "close_price"])


def open_interest(raw: DataFrame) -> DataFrame:
    one = _one(raw, {v: p for v, p in _TICKER_ROWS.items() if v != "gate"}, "open_interest")
    d = one.unionByName(_many(raw, {"gate": "$"}, "open_interest"))
    return d.select(*_META, F.when(F.col("exchange") == "gate", F.col("period")).alias("period"), F.coalesce(_time(_OPEN_INTEREST_TIME), "captured_at").alias("snapshot_time"), F.coalesce(_field(_OPEN_INTEREST), F.lit(0.0)).alias("open_interest"), F.lit(None).cast("double").alias("open_interest_value"), F.col("row").alias("raw_data"))


def long_short_ratios(raw: DataFrame) -> DataFrame:
    d = _many(raw, {v: p for v, p in _LIST_ROWS.items() if v in _RATIO_TIME}, "long_short_ratio")
    long_, short = _field(_RATIO_LONG), _field(_RATIO_SHORT)
    okx = F.col("exchange") == "okx"
    ratio = F.when(F.col("exchange") == "binance", number(F.get_json_object("row", "$.longShortRatio"))).otherwise(F.try_divide(long_, short))
    return d.select(*_META, "period", F.coalesce(_time(_RATIO_TIME), "captured_at").alias("snapshot_time"), F.when(okx, long_).alias("long_ratio"), F.when(okx, short).alias("short_ratio"), F.when(~okx, long_).alias("long_account_ratio"), F.when(~okx, short).alias("short_account_ratio"), ratio.alias("long_short_ratio"), F.col("row").alias("raw_data"))


def taker_flows(raw: DataFrame) -> DataFrame:
    d = _many(raw, {v: p for v, p in _LIST_ROWS.items() if v in _TAKER_TIME}, "taker_flow")
    buy, sell, none = _field(_TAKER_BUY), _field(_TAKER_SELL), F.lit(None).cast("double")
    b, s = F.coalesce(buy, F.lit(0.0)), F.coalesce(sell, F.lit(0.0))
    return d.select(*_META, "period", _time(_TAKER_TIME).alias("snapshot_time"), buy.alias("taker_buy_volume"), sell.alias("taker_sell_volume"), none.alias("taker_buy_quote_volume"), none.alias("taker_sell_quote_volume"), (b - s).alias("buy_sell_delta"), none.alias("buy_sell_delta_quote"), F.try_divide(b, s).alias("buy_sell_ratio"), F.col("row").alias("raw_data"))


def basis_premiums(raw: DataFrame) -> DataFrame:
    """Rates are stored in percent, the unit in which basis_percent is derived elsewhere."""
    d = _many(raw, {"binance": "$", "gate": "$"}, "basis")
    get = lambda k: number(F.get_json_object("row", f"$.{k}"))
    own = F.col("exchange") == "binance"
    at = F.when(own, from_epoch_ms(F.get_json_object("row", "$.timestamp"))).otherwise(from_epoch_s(F.get_json_object("row", "$[0]")))
    value = F.when(own, get("basis")).otherwise(number(F.get_json_object("row", "$[2]")))
    rate = F.when(own, get("basisRate"))
    return d.select(*_META, F.coalesce(at, "captured_at").alias("snapshot_time"), F.when(own, get("futuresPrice")).alias("futures_price"), F.when(own, get("indexPrice")).alias("index_price"), value.alias("basis"), value.alias("basis_value"), (rate * 100).alias("basis_percent"), (rate * 365 * 100).alias("annualized_basis_percent"), F.col("row").alias("raw_data"))


def orderbook_imbalances(raw: DataFrame) -> DataFrame:
    """Notional of both sides, their imbalance, mid price and spread; depth_levels is 10 by convention."""
    d = _one(raw, _BOOK_ROWS, "orderbook", "orderbook_imbalance")
    levels = lambda places: F.from_json(_json("row", places), "array<array<string>>")
    d = d.withColumn("bids", levels(_BOOK_BIDS)).withColumn("asks", levels(_BOOK_ASKS))
    each = lambda x: F.coalesce(number(x), F.lit(0.0))
    notional = lambda side: F.aggregate(F.coalesce(side, F.array().cast("array<array<string>>")), F.lit(0.0), lambda acc, x: acc + each(F.get(x, 0)) * each(F.get(x, 1)))
    d = d.withColumn("bid_notional", notional("bids")).withColumn("ask_notional", notional("asks"))
    bid, ask = each(F.get(F.get("bids", 0), 0)), each(F.get(F.get("asks", 0), 0))
    both = F.coalesce((F.size("bids") > 0) & (F.size("asks") > 0), F.lit(False))
    mid = F.when(both & (ask > 0), (bid + ask) / 2)
    whole = F.col("bid_notional") + F.col("ask_notional")
    none = F.lit(None).cast("double")
    return d.select(*_META, F.col("captured_at").alias("snapshot_time"), F.lit(10).alias("depth_levels"), mid.alias("mid_price"), F.when(mid > 0, (ask - bid) / mid * 10000).alias("spread_bps"), "bid_notional", "ask_notional", F.when(whole > 0, (F.col("bid_notional") - F.col("ask_notional")) / whole).alias("imbalance_ratio"), none.alias("imbalance_percent"), none.alias("bid_depth_usd"), none.alias("ask_depth_usd"), F.col("body").alias("raw_data"))


def liquidation_events(raw: DataFrame) -> DataFrame:
    """Events with sides in lower case; a closed long counts as a sell."""
    d = _many(raw, _LIQUIDATION_ROWS, "liquidation")
    at = _by_venue(_LIQUIDATION_TIME, lambda v, p: (from_epoch_s if v in ("gate", "mexc") else from_epoch_ms)(F.get_json_object("row", _path(p))))
    size, price, side = _field(_LIQUIDATION_SIZE), _field(_LIQUIDATION_PRICE), F.lower(_json("row", _LIQUIDATION_SIDE))
    side = F.when(F.col("exchange") == "gate", F.when(size > 0, "sell").otherwise("buy")).when(F.col("exchange").isin("okx", "mexc"), F.when(side == "long", "sell").otherwise("buy")).otherwise(side)
    notional = F.coalesce(price * F.abs(size), F.lit(0.0))
    stamp = F.coalesce(_json("row", _LIQUIDATION_TIME), F.lit(""))
    return d.select(*_META, F.concat_ws("-", text("source_symbol"), side, stamp).alias("event_key"), at.alias("event_time"), side.alias("side"), price.alias("price"), F.abs(size).alias("quantity"), notional.alias("notional"), notional.alias("usd_value"), F.col("row").alias("raw_data"))


def liquidation_event_buckets(raw: DataFrame) -> DataFrame:
    """Start of the five-minute bucket of each event, by event time."""
    return liquidation_events(raw).withColumn("bucket_time", time_bucket("event_time", 300))


#: Record type to the job that makes it.
JOBS = {"market_snapshots": market_snapshots, "klines": klines, "open_interest": open_interest, "long_short_ratios": long_short_ratios, "taker_flows": taker_flows, "basis_premiums": basis_premiums, "orderbook_imbalances": orderbook_imbalances, "liquidation_events": liquidation_events}


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """Record type to its DataFrame."""
    return {name: job(raw) for name, job in JOBS.items()}


def symbol_markets(symbols: DataFrame) -> DataFrame:
    """symbol_id, symbol, exchange, market_type, source_symbol of the tradable markets in each symbol's JSON list:
    supported venues, an active status, and a source symbol that is not blank."""
    one = "struct<exchange:string,market_type:string,source_symbol:string,status:string>"
    m = symbols.select("symbol_id", "symbol", F.explode(F.from_json("markets", f"array<{one}>")).alias("m"))
    clean = lambda f: F.lower(F.trim(F.coalesce(F.col(f"m.{f}"), F.lit(""))))
    m = m.select("symbol_id", "symbol", clean("exchange").alias("exchange"), clean("market_type").alias("market_type"), F.trim("m.source_symbol").alias("source_symbol"), clean("status").alias("status"))
    return m.where(F.col("exchange").isin(*VENUES) & F.col("status").isin("active", "live", "normal", "trading") & (F.coalesce("source_symbol", F.lit("")) != "")).drop("status").distinct()

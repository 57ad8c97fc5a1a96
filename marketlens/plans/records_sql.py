"""DuckDB SQL with the same rows as the queries in ``records``."""

from __future__ import annotations

from marketlens.plans.oracle import SQL as MARKET
from marketlens.plans.oracle import _AGG, _BASIS as _BASES
from marketlens.plans.oracle import _BOOK_SUMS, _BOOKS, _CANDLES, _CVD, _ENDS, _EVENTS, _FLOWS, _GRID, _GRID6, _KLINES, _LIQ, _METRICS, _TICKS, _asof, _latest, _sum, _with

SQL: dict[str, str] = {}

_P = """p AS (SELECT *, ['binance', 'okx', 'bybit', 'bitget', 'gate', 'mexc'][event_id % 6 + 1] AS x, date_trunc(CASE WHEN event_id % 6 = 4 THEN 'second' ELSE 'millisecond' END, ts) AS moment,
  date_trunc(CASE WHEN event_id % 6 IN (4, 5) THEN 'second' ELSE 'millisecond' END, ts) AS moment2 FROM e)"""
_SERIES = _with(_EVENTS, _P)
SQL["normalize_open_interest"] = _SERIES + """SELECT symbol_id, x AS exchange, 'S' AS source_symbol, CASE WHEN x = 'gate' THEN '5m' END AS period, moment AS snapshot_time, CAST(k AS DOUBLE) AS open_interest FROM p
UNION ALL SELECT symbol_id, x, 'S', '5m', moment, 0.0 FROM p WHERE x = 'gate'"""
SQL["normalize_long_short"] = _SERIES + """SELECT symbol_id, x AS exchange, 'S' AS source_symbol, '5m' AS period, moment AS snapshot_time, CASE WHEN x = 'okx' THEN value END AS long_ratio, CASE WHEN x = 'okx' THEN CAST(k AS DOUBLE) END AS short_ratio,
  CASE WHEN x <> 'okx' THEN value END AS long_account_ratio, CASE WHEN x <> 'okx' THEN CAST(k AS DOUBLE) END AS short_account_ratio, CASE WHEN x = 'binance' THEN 1.5 ELSE value / nullif(k, 0) END AS long_short_ratio FROM p WHERE x <> 'mexc'"""
SQL["normalize_taker_flow"] = _SERIES + """SELECT symbol_id, x AS exchange, '5m' AS period, moment AS snapshot_time, value AS taker_buy_volume, CAST(k AS DOUBLE) AS taker_sell_volume, round(value - k, 6) AS buy_sell_delta, round(value / nullif(k, 0), 6) AS buy_sell_ratio
  FROM p WHERE x IN ('binance', 'okx', 'gate')"""
SQL["normalize_basis"] = _SERIES + """SELECT symbol_id, x AS exchange, moment AS snapshot_time, CASE WHEN x = 'binance' THEN value END AS futures_price, CASE WHEN x = 'binance' THEN CAST(k AS DOUBLE) END AS index_price, CASE WHEN x = 'binance' THEN 2.5 ELSE k END AS basis,
  CASE WHEN x = 'binance' THEN 2.5 ELSE k END AS basis_value, CASE WHEN x = 'binance' THEN 25.0 END AS basis_percent, CASE WHEN x = 'binance' THEN 9125.0 END AS annualized_basis_percent FROM p WHERE x IN ('binance', 'gate')"""
SQL["normalize_liquidations"] = _SERIES + """, q AS (SELECT *, CASE x WHEN 'gate' THEN CASE WHEN k % 2 = 1 AND k > 0 THEN 'sell' ELSE 'buy' END ELSE CASE WHEN k % 2 = 1 THEN 'sell' ELSE 'buy' END END AS s FROM p WHERE x <> 'bitget')
SELECT symbol_id, x AS exchange, 'S' AS source_symbol, 'S-' || s || '-' || CASE WHEN x IN ('gate', 'mexc') THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) ELSE epoch_us(ts) // 1000 END AS event_key, moment2 AS event_time, s AS side, value AS price,
  CAST(k AS DOUBLE) AS quantity, round(value * k, 4) AS notional, time_bucket(INTERVAL 5 MINUTE, moment2) AS bucket_time FROM q"""

# ---- quarantine: the first rule that a row fails ----

# one k in ten has one negative measure, by event
_MEASURES = """['last_price', 'mark_price', 'index_price', 'bid_price', 'ask_price', 'volume_24h', 'quote_volume_24h', 'open_interest', 'open_interest_value', 'open_price', 'high_price', 'low_price', 'close_price', 'volume', 'quote_volume',
  'taker_buy_volume', 'taker_sell_volume', 'taker_buy_quote_volume', 'taker_sell_quote_volume', 'price', 'quantity', 'notional', 'usd_value', 'futures_price', 'spot_price', 'mid_price', 'spread_bps', 'bid_notional', 'ask_notional',
  'bid_depth_usd', 'ask_depth_usd', 'bid_depth_1pct_usd', 'ask_depth_1pct_usd', 'bid_depth_2pct_usd', 'ask_depth_2pct_usd', 'bid_depth_5pct_usd', 'ask_depth_5pct_usd', 'long_liquidation_usd', 'long_liquidation_notional',
  'short_liquidation_usd', 'short_liquidation_notional', 'total_liquidation_usd', 'total_liquidation_notional', 'largest_liquidation_usd']"""
_ROWS = f"""m AS (SELECT {_MEASURES} AS names), r AS (SELECT symbol_id, CASE WHEN k = 3 THEN ' ' ELSE exchange END AS exchange, k, CASE WHEN k % 10 = 9 THEN names[event_id % len(names) + 1] END AS wrong FROM e, m)"""


def _judged(record: str, time: str, *cases: str, source: str = "") -> str:
    """cases: what is tried after source and time, in order; source: after source, before time."""
    first = [
        "WHEN NOT symbol_id > 0 THEN 'invalid_source|symbol_id must be positive'",
        "WHEN trim(exchange) = '' THEN 'invalid_source|exchange is required'",
        source,
        f"WHEN k = 6 THEN 'invalid_timestamp|{time} is required'",
        f"WHEN k = 5 THEN 'future_timestamp|{time} lies in the future'",
    ]
    return _with(_EVENTS, _ROWS) + f"""SELECT symbol_id, exchange, '{record}' AS data_type, split_part(issue, '|', 1) AS issue_type, split_part(issue, '|', 2) AS error, count(*) AS issues
FROM (SELECT *, CASE {" ".join([*first, *cases])} END AS issue FROM r) WHERE issue IS NOT NULL GROUP BY ALL"""


def _negative(*columns: str) -> str:
    return f"WHEN wrong IN ({', '.join(repr(c) for c in columns)}) THEN 'invalid_value|' || wrong || ' must not be negative'"


def _mismatch(column: str) -> str:
    return f"WHEN k IN (11, 12) THEN 'interval_mismatch|{column} is not the requested one'"


_BAD = "WHEN k = 11 THEN 'invalid_period|malformed period in {}'"
_WILD = "WHEN k = 17 THEN 'funding_outlier|funding_rate is implausible'"
_KLINE = ("open_price", "high_price", "low_price", "close_price", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")
_TAKER = ("taker_buy_volume", "taker_sell_volume", "taker_buy_quote_volume", "taker_sell_quote_volume")
_LIQUIDATED = ("long_liquidation_usd", "long_liquidation_notional", "short_liquidation_usd", "short_liquidation_notional", "total_liquidation_usd", "total_liquidation_notional", "largest_liquidation_usd")
_BASIS = _judged("basis", "snapshot_time", _negative("futures_price", "mark_price", "index_price", "spot_price"))
SQL["quarantine_market_snapshot"] = _judged("market_snapshot", "snapshot_time", _WILD, _negative("last_price", "mark_price", "index_price", "bid_price", "ask_price", "volume_24h", "quote_volume_24h", "open_interest"))
SQL["quarantine_kline"] = _judged("kline", "open_time", _BAD.format("interval"), _negative(*_KLINE))
SQL["quarantine_interval"] = _judged("kline", "open_time", "ELSE 'interval_mismatch|interval is not the requested one'")
SQL["quarantine_open_interest"] = _judged("open_interest", "snapshot_time", _negative("open_interest", "open_interest_value"))
SQL["quarantine_open_interest_history"] = _judged("open_interest_history", "snapshot_time", "WHEN k = 12 THEN 'invalid_period|period is required'", _BAD.format("period"), _negative("open_interest", "open_interest_value"))
SQL["quarantine_funding"] = _judged("funding", "snapshot_time", _WILD, _negative("mark_price", "index_price"))
SQL["quarantine_funding_history"] = _judged("funding_history", "funding_time", _WILD, _negative("mark_price"))
SQL["quarantine_long_short_ratio"] = _judged("long_short_ratio", "snapshot_time", _BAD.format("period"))
SQL["quarantine_taker_flow"] = _judged("taker_flow", "snapshot_time", _BAD.format("period"), _negative(*_TAKER))
SQL["quarantine_cvd"] = _judged("cvd", "snapshot_time", _BAD.format("period"))
SQL["quarantine_liquidation_event"] = _judged("liquidation_event", "event_time", "WHEN k = 15 THEN 'invalid_value|side is required'", _negative("price", "quantity", "notional", "usd_value"))
SQL["quarantine_liquidation_aggregate"] = _judged("liquidation_aggregate", "bucket_time", _BAD.format("period"), _negative(*_LIQUIDATED))
SQL["quarantine_basis"] = SQL["quarantine_asked_period_of_none"] = _BASIS
SQL["quarantine_orderbook"] = _judged("orderbook", "snapshot_time", "WHEN k = 14 THEN 'invalid_value|depth_levels must be positive'", _negative("mid_price", "bid_notional", "ask_notional", "bid_depth_usd", "ask_depth_usd", *[f"{s}_depth_{p}pct_usd" for s in ("bid", "ask") for p in (1, 2, 5)]))
SQL["quarantine_divergence"] = _judged("divergence", "snapshot_time", "WHEN k = 15 THEN 'invalid_value|data_type is required'")
SQL["quarantine_asked_kline"] = _judged("kline", "open_time", _mismatch("interval"), _negative(*_KLINE))
SQL["quarantine_asked_taker_flow"] = _judged("taker_flow", "snapshot_time", _mismatch("period"), _negative(*_TAKER))
SQL["quarantine_asked_cvd"] = _judged("cvd", "snapshot_time", _mismatch("period"))
SQL["quarantine_asked_long_short_ratio"] = _judged("long_short_ratio", "snapshot_time", _mismatch("period"))
SQL["quarantine_asked_liquidation_aggregate"] = _judged("liquidation_aggregate", "bucket_time", _mismatch("period"), _negative(*_LIQUIDATED))
SQL["quarantine_asked_symbol"] = _judged("funding", "snapshot_time", _WILD, _negative("mark_price", "index_price"), source="WHEN symbol_id = 2 THEN 'symbol_mismatch|source_symbol is not the requested one'")

# ---- upserts ----

SQL["upsert_rows"] = _with(_TICKS) + """SELECT symbol_id, exchange, h AS hour, CASE WHEN m % 3 = 0 THEN m + 2 ELSE m END AS event_id, CASE WHEN m % 3 = 0 THEN 1.0 ELSE p END AS last_price
  FROM (SELECT symbol_id, exchange, date_trunc('hour', snapshot_time) AS h, max(event_id) AS m, max(last_price) AS p FROM ticks GROUP BY ALL)"""
SQL["upsert_liquidations"] = _with(_EVENTS) + """SELECT CAST(event_id AS VARCHAR) AS event_key, symbol_id, CASE exchange WHEN 'purchase' THEN 'long' WHEN 'error' THEN 'short' ELSE 'unknown' END AS side, ts AS event_time,
  round(CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END, 4) AS price, round(CASE WHEN event_id % 2 = 0 THEN 5.0 ELSE value * (k + 1) END, 4) AS usd_value FROM e"""
SQL["upsert_aggregates"] = _with(_TICKS, _GRID6, _latest(), _AGG, _FLOWS, _CVD, _LIQ, _BASES, _BOOKS, _BOOK_SUMS, _ENDS, _METRICS) + f""", raws AS (SELECT symbol_id, as_of, '{{' || string_agg('"' || exchange || '":{{"k": ' || k || ', "status": "ok"}}', ',' ORDER BY exchange) || '}}' AS raw FROM latest WHERE NOT failed GROUP BY symbol_id, as_of),
sums AS (SELECT symbol_id, as_of, {_sum("cvd_value")} AS total_cvd FROM ({_asof("cvd", "t.exchange, t.cvd_value")}) GROUP BY symbol_id, as_of),
hits AS (SELECT symbol_id, as_of, unnest([CASE WHEN liquidation_sum_usd >= 100000 THEN 'large_liquidation_cluster' END, CASE WHEN abs(basis_avg) >= 0.5 THEN 'elevated_basis' END, CASE WHEN funding_max >= 0.004 THEN 'positive_funding_extreme' END, CASE WHEN funding_min <= -0.004 THEN 'negative_funding_extreme' END]) || '@' || "window" AS flag,
  unnest([1, 2, 3, 4]) + 10 * list_position(['1h', '4h', '24h', '7d'], "window") AS place FROM metrics UNION ALL SELECT symbol_id, as_of, 'orderbook_imbalance', 99 FROM book_sums WHERE abs(avg_imbalance_percent) >= 50),
flags AS (SELECT symbol_id, as_of, string_agg(flag, ',' ORDER BY place) AS flags FROM hits GROUP BY ALL),
day AS (SELECT symbol_id, as_of, liquidation_sum_usd AS liquidations_24h FROM metrics WHERE "window" = '24h'), week AS (SELECT symbol_id, as_of, basis_avg AS basis_7d FROM metrics WHERE "window" = '7d')
SELECT symbol_id, as_of AS snapshot_time, exchange_count, price_avg, CASE WHEN symbol_id % 2 <> 0 THEN price_weighted END AS price_weighted, CASE WHEN symbol_id % 2 <> 0 THEN price_weighted END AS weighted_price, coalesce(total_cvd, 0.0) AS total_cvd, avg_imbalance_percent,
  coalesce(total_bid_depth_usd, 0.0) AS total_bid_depth_usd, '["' || replace(available_exchanges, ',', '","') || '"]' AS available_exchanges, raw AS raw_by_exchange, raw AS raw_data,
  '{{"max_snapshot_age_seconds":86400,"snapshot_time":"' || strftime(as_of, '%Y-%m-%dT%H:%M:%SZ') || '","stale_cutoff":"' || strftime(as_of - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') || '","included_exchanges":["' || replace(available_exchanges, ',', '","') || '"]'
    || CASE WHEN skipped_exchanges = '' THEN '' ELSE ',"skipped_exchanges":{{"' || replace(skipped_exchanges, ',', '":["degraded_raw_data"],"') || '":["degraded_raw_data"]}}' END || '}}' AS quality_metadata,
  CASE WHEN symbol_id % 2 = 0 THEN '' ELSE coalesce(flags, '') END AS flags, '1h' AS first_window, strftime(as_of - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS first_start, liquidations_24h, basis_7d, exchange_count AS venues_now
  FROM agg JOIN raws USING (symbol_id, as_of) JOIN day USING (symbol_id, as_of) JOIN week USING (symbol_id, as_of) LEFT JOIN sums USING (symbol_id, as_of) LEFT JOIN book_sums USING (symbol_id, as_of) LEFT JOIN flags USING (symbol_id, as_of)"""
SQL["upsert_volatility"] = f"""SELECT symbol_id, 'aggregate' AS exchange, CASE WHEN symbol_id % 3 <> 0 THEN 'perp' END AS market_type, CAST(NULL AS VARCHAR) AS source_symbol, period, as_of AS snapshot_time, atr, close_price, realized_volatility,
  CASE WHEN symbol_id % 2 <> 0 THEN range_percent_24h END AS range_percent_24h, CASE WHEN candles > 0 THEN '{{"candles": ' || candles || '}}' ELSE '{{}}' END AS raw_data FROM ({MARKET["volatility"]})"""
SQL["upsert_market_structure"] = _with(_TICKS, _GRID6, _KLINES, _CANDLES) + """, s AS (SELECT g.symbol_id, g.as_of, count(c.close) AS n, arg_min(c.close, c.open_time) AS fc, arg_max(c.close, c.open_time) AS lc, max(c.high) AS high, min(c.low) AS low
  FROM grid g LEFT JOIN candles c ON c.symbol_id = g.symbol_id AND c.open_time >= g.as_of - INTERVAL 24 HOUR AND c.open_time <= g.as_of GROUP BY ALL),
m AS (SELECT *, coalesce((lc - fc) / nullif(fc, 0) * 100, 0.0) AS change, coalesce((high - low) / nullif(lc, 0) * 100, 0.0) AS wide FROM s),
t AS (SELECT symbol_id, as_of, CASE WHEN n < 2 THEN 'unknown' WHEN change > 0.2 THEN 'bullish' WHEN change < -0.2 THEN 'bearish' ELSE 'sideways' END AS trend, CASE WHEN n >= 2 THEN high END AS high, CASE WHEN n >= 2 THEN low END AS low,
  CASE WHEN symbol_id % 2 = 0 THEN 'ranging' WHEN n < 2 THEN 'unknown' WHEN wide < 1 THEN 'compression' WHEN wide > 5 OR abs(change) > 3 THEN 'expansion' ELSE 'ranging' END AS state FROM m)
SELECT symbol_id, 'all' AS exchange, '24h' AS period, as_of AS snapshot_time, trend AS trend_direction, state AS structure_state, high AS last_swing_high, low AS last_swing_low, trend, low AS support_price, high AS resistance_price, state AS breakout_state FROM t"""
SQL["upsert_divergence"] = _with(_TICKS) + """, d AS (SELECT symbol_id, exchange, date_trunc('hour', snapshot_time) AS h, max(last_price) AS hi, min(last_price) AS lo FROM ticks GROUP BY ALL),
j AS (SELECT *, CASE WHEN exchange = 'view' THEN '{}' ELSE '{"low": ' || printf('%.2f', lo) || '}' END AS j FROM d)
SELECT symbol_id, 'price' AS data_type, 'all' AS reference_exchange, exchange AS compared_exchange, h AS snapshot_time, CASE WHEN exchange = 'view' THEN 0.0 ELSE hi END AS price_max, lo AS price_min, j AS metadata, j AS metrics, j AS quality_metadata FROM j"""
SQL["upsert_issues"] = _with(_TICKS) + """SELECT symbol_id || '|' || exchange AS issue_key, min(snapshot_time) AS first_seen_at, max(snapshot_time) + CASE WHEN exchange IN ('click', 'view') THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS last_seen_at,
  CASE WHEN symbol_id % 2 <> 0 THEN 'ignored' WHEN exchange IN ('click', 'view') THEN 'open' ELSE 'resolved' END AS status, CASE WHEN exchange IN ('click', 'view') THEN 'error' ELSE 'warning' END AS severity FROM ticks GROUP BY symbol_id, exchange"""
SQL["upsert_gaps"] = _with(_TICKS) + """, g AS (SELECT symbol_id || '|' || exchange || '|' || CAST(CAST(snapshot_time AS DATE) AS VARCHAR) AS gap_key, min(snapshot_time) AS lo, max(snapshot_time) AS hi, max(event_id) AS m FROM ticks GROUP BY symbol_id, exchange, CAST(snapshot_time AS DATE)),
h AS (SELECT *, CASE WHEN m % 3 = 0 THEN hi + INTERVAL 1 DAY ELSE hi END AS z FROM g)
SELECT gap_key, lo AS gap_start, z AS gap_end, m AS last_event, z AS detected_at, CASE WHEN m % 2 = 0 THEN 'done' ELSE 'pending' END AS backfill_status FROM h"""
SQL["upsert_health"] = _with(_TICKS) + """, h AS (SELECT symbol_id, exchange, max(snapshot_time) + INTERVAL 1 MINUTE AS hi, min(snapshot_time) AS lo FROM ticks GROUP BY ALL)
SELECT CAST(symbol_id AS VARCHAR) AS collector, exchange, CASE WHEN symbol_id % 3 = 0 THEN 'degraded' ELSE 'healthy' END AS status, hi AS heartbeat_at, CASE WHEN symbol_id % 3 = 2 THEN hi ELSE lo END AS last_success_at,
  CASE WHEN symbol_id % 3 = 0 THEN hi END AS last_error_at, CASE WHEN symbol_id % 3 = 0 THEN 'timeout' END AS last_error FROM h"""

# ---- keys and lists ----

SQL["liquidation_keys"] = _with(_EVENTS) + r"""SELECT CAST(event_id AS VARCHAR) AS event_key, 'liq:' || sha1(concat_ws('|', exchange, 'S' || symbol_id, CASE exchange WHEN 'purchase' THEN 'long' WHEN 'error' THEN 'short' ELSE 'unknown' END,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || repeat('0', 16), (k + 1) || '.' || repeat('0', 18), strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(rtrim(strftime(ts, '.%f'), '0'), '\.$', '') || 'Z')) AS natural_key FROM e"""


def _page(table: str, where: str, order: str, limit: int, offset: int = 0, *parts: str) -> str:
    """table: columns symbol_id, exchange, moment, value and what order needs."""
    return _with(_TICKS, *parts, f"f AS (SELECT * FROM ({table}) WHERE {where})") + f"SELECT symbol_id, exchange, moment, round(value, 4) AS value, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY {order} LIMIT {limit} OFFSET {offset}"


_NEWEST = "moment DESC, symbol_id, exchange"
_T = "SELECT symbol_id, exchange, snapshot_time AS moment, {} AS value, k FROM ticks"
SQL["open_interest_page"] = _page(_T.format("open_interest"), "symbol_id = 1", _NEWEST, 30)
SQL["open_interest_history_page"] = _page(_T.format("open_interest"), "symbol_id = 2 AND exchange = 'view'", "moment, symbol_id, exchange", 30)
SQL["funding_page"] = _page(_T.format("funding_rate"), "exchange = 'view'", _NEWEST, 40, 5)
_RATIO = "SELECT symbol_id, x AS exchange, moment, CASE WHEN x = 'binance' THEN 1.5 ELSE value / nullif(k, 0) END AS value FROM p WHERE x <> 'mexc'"
_BOOK = "SELECT symbol_id, x AS exchange, ts AS moment, (value * k + value - (value + 1) * 2) / (value * k + value + (value + 1) * 2) AS value FROM p"
SQL["long_short_ratio_page"] = _page(_RATIO, "symbol_id = 5", _NEWEST, 30, 0, _P)
SQL["taker_flow_page"] = _page(_T.format("CASE WHEN exchange IN ('purchase', 'signup') THEN last_price ELSE 0.0 END"), "moment BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", _NEWEST, 100)
_CVD_ROWS = "SELECT symbol_id, exchange, snapshot_time AS moment, CAST(sum(CAST(CASE WHEN exchange IN ('purchase', 'signup') THEN last_price ELSE -last_price END AS DECIMAL(28,6))) OVER (PARTITION BY symbol_id, exchange ORDER BY snapshot_time ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM ticks"
SQL["cvd_page"] = _page(_CVD_ROWS, "symbol_id = 7", _NEWEST, 30)
SQL["liquidations_page"] = _page(_T.format("last_price * (k + 1)"), "symbol_id = 6 AND exchange = 'error'", _NEWEST, 30)
SQL["basis_page"] = _page(_T.format("(k - 50) / 20.0"), "symbol_id = 8", _NEWEST, 30)
SQL["orderbook_page"] = _page(_BOOK, "symbol_id = 9 AND moment >= TIMESTAMP '2024-01-20'", _NEWEST, 30, 0, _P)
_DIVERGENCE = f"SELECT symbol_id, 'all' AS exchange, as_of AS moment, price_spread_percent AS value FROM ({MARKET['exchange_divergence']})"
SQL["divergence_page"] = _page(_DIVERGENCE, "symbol_id = 3 AND moment <= TIMESTAMP '2024-01-20'", _NEWEST, 30, 100)
_DETAIL = {
    "klines": "SELECT symbol_id, exchange, open_time AS moment, close_price AS value FROM klines", "open_interest": _T.format("open_interest"), "funding": _T.format("funding_rate"), "long_short_ratio": _RATIO, "taker_flow": _T.format("CASE WHEN exchange IN ('purchase', 'signup') THEN last_price ELSE 0.0 END"),
    "cvd": _CVD_ROWS, "liquidations": _T.format("last_price * (k + 1)"), "basis": _T.format("(k - 50) / 20.0"), "orderbook": _BOOK, "divergence": _DIVERGENCE, "market": _T.format("last_price"),
}
SQL["symbol_detail"] = _with(_TICKS, _GRID, _latest(), _AGG, _KLINES, _P) + " UNION ALL ".join(
    ["SELECT * FROM (SELECT 'latest' AS part, as_of AS moment, round(price_avg, 4) AS value FROM agg WHERE symbol_id = 4 ORDER BY as_of DESC LIMIT 1)", *[f"SELECT * FROM (SELECT '{name}', moment, round(value, 4) FROM ({rows}) WHERE symbol_id = 4 ORDER BY moment DESC, exchange LIMIT 10)" for name, rows in _DETAIL.items()]]
)
SQL["admin_page"] = """WITH f AS (SELECT o_orderkey AS id, o_custkey AS symbol_id, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1997-06-30')
SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY created_at DESC, id LIMIT 25 OFFSET 10"""

# ---- streams ----

SQL["stream_no_future"] = _with(_TICKS) + "SELECT event_id, snapshot_time FROM ticks WHERE k % 5 <> 0"
SQL["stream_running_delta"] = _with(_TICKS) + """, f AS (SELECT symbol_id, exchange, '1h' AS period, snapshot_time, CASE WHEN exchange IN ('purchase', 'signup') THEN last_price ELSE -last_price END AS d FROM ticks)
SELECT symbol_id, exchange, period, snapshot_time, round(CAST(sum(CAST(d AS DECIMAL(28,6))) OVER (PARTITION BY symbol_id, exchange ORDER BY snapshot_time ROWS UNBOUNDED PRECEDING) AS DOUBLE), 4) AS cvd_value, round(d, 4) AS cvd_change FROM f"""
SQL["bucket_volume"] = _with(_EVENTS) + f"""SELECT symbol_id, exchange, time_bucket(INTERVAL 1 MINUTE, ts) AS bucket_time, '1m' AS period, count(*) FILTER (WHERE exchange = 'purchase') AS long_liquidation_count,
  count(*) FILTER (WHERE exchange <> 'purchase') AS short_liquidation_count, {_sum("value * (k + 1)")} AS total_liquidation_usd FROM e WHERE symbol_id <> 0 GROUP BY ALL"""

SQL["stream_expiring"] = _with(_TICKS) + """, v AS (SELECT exchange || ':' || source_symbol AS key, snapshot_time AS ts, last_price AS p, lead(snapshot_time) OVER (PARTITION BY exchange, source_symbol ORDER BY snapshot_time) AS later, max(snapshot_time) OVER () AS newest FROM ticks),
w AS (SELECT *, '{"last_price":' || CASE WHEN p = floor(p) THEN printf('%.1f', p) ELSE CAST(p AS VARCHAR) END || '}' AS payload FROM v)
SELECT key, ts AS at, payload, 'set' AS action FROM w
UNION ALL SELECT key, ts + INTERVAL 2 HOUR, payload, 'expire' FROM w WHERE later - ts >= INTERVAL 2 HOUR OR (later IS NULL AND ts + INTERVAL 2 HOUR <= newest - INTERVAL 10 MINUTE)"""
SQL["stream_corrected_delta"] = SQL["stream_running_delta"]
SQL["stream_upsert"] = _with(_TICKS) + "SELECT symbol_id, exchange, max(snapshot_time) AS snapshot_time, arg_max(last_price, snapshot_time) AS last_price, CAST(CAST(snapshot_time AS DATE) AS VARCHAR) AS day FROM ticks GROUP BY symbol_id, exchange, CAST(snapshot_time AS DATE)"
SQL["stream_latest_batches"] = MARKET["stream_latest"]
SQL["stream_bucket_batches"] = f"SELECT * FROM ({MARKET['stream_buckets']}) WHERE bucket_time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"
SQL["stream_liquidation_batches"] = f"SELECT * FROM ({MARKET['stream_liquidations']}) WHERE bucket_time + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events WHERE user_id % 10 <> 0) - INTERVAL 6 HOUR"
SQL["stream_dedupe_batches"] = f"SELECT *, CAST(0 AS BIGINT) AS repeats FROM ({MARKET['stream_dedupe']})"
SQL["upsert_partitions"] = _with(_TICKS) + "SELECT event_id, symbol_id, CASE WHEN day(snapshot_time) % 5 = 0 AND event_id % 2 = 0 THEN -last_price ELSE last_price END AS last_price, CAST(CAST(snapshot_time AS DATE) AS VARCHAR) AS day FROM ticks"
SQL["audited_payloads"] = _with(_EVENTS) + r"""SELECT exchange, data_type, payload_time, payload_hash, min(source_symbol) AS source_symbol, min(payload) AS payload, min(capture_reason) AS capture_reason, CAST(sum(n) AS BIGINT) AS captures FROM (
  SELECT CASE WHEN NOT torn THEN x END AS exchange, CASE WHEN NOT torn THEN 'ticker' END AS data_type, CASE WHEN NOT torn THEN symbol END AS source_symbol, CASE WHEN NOT torn THEN date_trunc('second', ts) END AS payload_time, n,
    CASE WHEN torn THEN left(line, 40) ELSE body END AS payload, sha256(CASE WHEN torn THEN left(line, 40) ELSE body END) AS payload_hash,
    CASE WHEN torn THEN 'failed_job' WHEN body = 'gone' OR x = 'mexc' OR (k % 13 = 0 AND x IN ('binance', 'okx', 'bitget')) THEN 'quality_issue' ELSE 'audit' END AS capture_reason
  FROM (SELECT *, '{"exchange":" ' || upper(x) || '","data_type":"ticker",' || coalesce('"source_symbol":"' || symbol || '",', '') || '"payload_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","payload":"' || replace(body, '"', '\"') || '"}' AS line
    FROM (SELECT *, ['binance', 'okx', 'bybit', 'bitget', 'gate', 'mexc'][event_id % 6 + 1] AS x, k % 11 = 0 AS torn, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN k % 3 <> 0 THEN 'S' || symbol_id END AS symbol,
      CASE WHEN k % 13 = 0 THEN '{"code": -1121}' WHEN k % 7 = 0 THEN 'gone' ELSE '{"k": ' || k || '}' END AS body FROM e))) GROUP BY exchange, data_type, coalesce(source_symbol, ''), payload_time, payload_hash"""

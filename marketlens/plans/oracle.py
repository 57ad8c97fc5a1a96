"""DuckDB SQL with the same rows as the queries in ``market``, over the driver's tables."""

from __future__ import annotations

# ---- the market facts as common table expressions ----

_EVENTS = "e AS (SELECT event_id, ts, user_id % 10 AS symbol_id, event_type AS exchange, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_TICKS = (
    _EVENTS
    + """,
ticks AS (SELECT event_id, symbol_id, exchange, 'S' || symbol_id AS source_symbol, ts AS snapshot_time, value AS last_price, value * 2 AS volume_24h,
  value * 3 AS quote_volume_24h, CAST(k AS DOUBLE) AS open_interest, (k - 50) / 10000.0 AS funding_rate, k, k % 17 = 0 AS failed FROM e)"""
)


def _grid(step: str) -> str:
    return f"""grid AS (SELECT symbol_id, unnest(generate_series(date_trunc('day', min(snapshot_time)) + INTERVAL 1 DAY, max(snapshot_time), INTERVAL {step})) AS as_of
  FROM ticks GROUP BY symbol_id)"""


_GRID, _GRID6 = _grid("1 HOUR"), _grid("6 HOUR")


def _latest(grid: str = "grid") -> str:
    return f"""latest AS (SELECT * FROM (SELECT g.symbol_id, g.as_of, t.* EXCLUDE (symbol_id), row_number() OVER (PARTITION BY g.symbol_id, g.as_of, t.exchange ORDER BY t.snapshot_time DESC) AS rn
  FROM {grid} g JOIN ticks t ON t.symbol_id = g.symbol_id AND t.snapshot_time <= g.as_of AND t.snapshot_time >= g.as_of - INTERVAL 1 DAY) WHERE rn = 1)"""


_WINDOWS = "windows AS (SELECT * FROM (VALUES ('1h', INTERVAL 1 HOUR), ('4h', INTERVAL 4 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 168 HOUR)) w(\"window\", w))"


def _sum(x: str, scale: int = 6) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,{scale}))) AS DOUBLE)"


def _avg(x: str, scale: int = 6) -> str:
    return f"({_sum(x, scale)} / nullif(count({x}), 0))"


_FLOWS = """flows AS (SELECT symbol_id, exchange, ts AS snapshot_time, '1h' AS period, CASE WHEN exchange IN ('purchase', 'signup') THEN value ELSE 0.0 END AS buy,
  CASE WHEN exchange IN ('purchase', 'signup') THEN 0.0 ELSE value END AS sell, k % 17 = 0 AS failed FROM e)"""
_CVD = """cvd AS (SELECT *, CAST(sum(CAST(buy - sell AS DECIMAL(28,6))) OVER (PARTITION BY symbol_id, exchange, period ORDER BY snapshot_time ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cvd_value,
  coalesce(CAST(sum(CAST(buy - sell AS DECIMAL(28,6))) OVER (PARTITION BY symbol_id, exchange, period ORDER BY snapshot_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS previous FROM flows)"""
_LIQ = f"""liq AS (SELECT symbol_id, exchange, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_time, count(*) FILTER (WHERE exchange = 'purchase') AS long_liquidation_count,
  count(*) FILTER (WHERE exchange <> 'purchase') AS short_liquidation_count, coalesce({_sum("CASE WHEN exchange = 'purchase' THEN value * (k + 1) END")}, 0.0) AS long_liquidation_usd,
  coalesce({_sum("CASE WHEN exchange <> 'purchase' THEN value * (k + 1) END")}, 0.0) AS short_liquidation_usd, {_sum("value * (k + 1)")} AS total_liquidation_usd,
  max(value * (k + 1)) AS largest_liquidation_usd FROM e WHERE symbol_id <> 0 GROUP BY ALL)"""
_KLINES = """klines AS (SELECT symbol_id, exchange, 'S' || symbol_id AS source_symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS open_time, max(ts) AS close_time, arg_min(value, (ts, event_id)) AS open_price,
  max(value) AS high_price, min(value) AS low_price, arg_max(value, (ts, event_id)) AS close_price, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume,
  CAST(sum(CAST(value * 3 AS DECIMAL(18,2))) AS DOUBLE) AS quote_volume, count(*) AS trade_count, max(k) % 17 = 0 AS failed FROM e GROUP BY symbol_id, exchange, time_bucket(INTERVAL 5 MINUTE, ts))"""
_CANDLES = f"candles AS (SELECT symbol_id, open_time, {_avg('open_price')} AS open, max(high_price) AS high, min(low_price) AS low, {_avg('close_price')} AS close FROM klines WHERE NOT failed AND low_price > 0 GROUP BY symbol_id, open_time)"
_SYMBOLS = """symbols AS (SELECT CAST(n_nationkey AS BIGINT) AS symbol_id, n_name AS symbol, substr(n_name, 1, 3) AS base_asset, r_name AS quote_asset,
  CASE WHEN n_nationkey <> 13 THEN CAST(n_nationkey AS INTEGER) END AS rank, n_nationkey % 7 <> 0 AS is_active, n_nationkey % 5 + 1 AS n_markets FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_POINT = f"""point AS (SELECT symbol_id, as_of, {_avg("CASE WHEN last_price > 0 THEN last_price END")} AS price, {_sum("volume_24h")} AS volume, {_sum("open_interest")} AS open_interest, count(*) AS exchange_count
  FROM latest WHERE NOT failed GROUP BY symbol_id, as_of)"""
_AGG = f"""agg AS (SELECT symbol_id, as_of, count(*) FILTER (WHERE NOT failed) AS exchange_count, {_avg("CASE WHEN NOT failed AND last_price > 0 THEN last_price END")} AS price_avg,
  {_sum("CASE WHEN NOT failed AND last_price > 0 THEN last_price * quote_volume_24h END")} / nullif({_sum("CASE WHEN NOT failed AND last_price > 0 THEN quote_volume_24h END")}, 0) AS price_weighted,
  coalesce({_sum("CASE WHEN NOT failed THEN volume_24h END")}, 0.0) AS total_volume_24h, coalesce({_sum("CASE WHEN NOT failed THEN quote_volume_24h END")}, 0.0) AS total_quote_volume_24h,
  coalesce({_sum("CASE WHEN NOT failed THEN open_interest END")}, 0.0) AS total_open_interest, {_sum("CASE WHEN NOT failed THEN open_interest * last_price END")} AS total_open_interest_value,
  {_avg("CASE WHEN NOT failed THEN funding_rate END")} AS avg_funding_rate, min(CASE WHEN NOT failed THEN funding_rate END) AS min_funding_rate, max(CASE WHEN NOT failed THEN funding_rate END) AS max_funding_rate,
  coalesce(string_agg(exchange, ',' ORDER BY exchange) FILTER (WHERE NOT failed), '') AS available_exchanges, coalesce(string_agg(exchange, ',' ORDER BY exchange) FILTER (WHERE failed), '') AS skipped_exchanges
  FROM latest GROUP BY symbol_id, as_of HAVING count(*) FILTER (WHERE NOT failed) > 0)"""
_BASIS = "basis AS (SELECT symbol_id, exchange, ts AS snapshot_time, value + k AS futures_price, value AS index_price, (k - 50) / 20.0 AS basis_percent, k % 17 = 0 AS failed FROM e)"
_GAPS = """gaps AS (SELECT * FROM (SELECT symbol_id, exchange, lag(open_time) OVER (PARTITION BY symbol_id, exchange ORDER BY open_time) AS gap_start, open_time AS gap_end FROM klines
  WHERE open_time >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND open_time <= TIMESTAMP '2024-01-31') WHERE gap_end - gap_start > INTERVAL 2 HOUR)"""


def _asof(table: str, columns: str, where: str = "true", grid: str = "grid") -> str:
    return f"""SELECT * FROM (SELECT g.symbol_id, g.as_of, {columns}, row_number() OVER (PARTITION BY g.symbol_id, g.as_of, t.exchange ORDER BY t.snapshot_time DESC) AS rn
  FROM {grid} g JOIN {table} t ON t.symbol_id = g.symbol_id AND t.snapshot_time <= g.as_of AND t.snapshot_time >= g.as_of - INTERVAL 1 DAY WHERE {where}) WHERE rn = 1"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# every instant at which a window starts or ends
_ENDS = f"{_WINDOWS}, ends AS (SELECT g.symbol_id, g.as_of, w.\"window\", w.w, g.as_of - w.w AS start_time FROM grid g CROSS JOIN windows w), instants AS (SELECT symbol_id, as_of FROM grid UNION SELECT symbol_id, start_time FROM ends)"


def _over(table: str, ts: str, aggs: str, where: str = "true") -> str:
    return f"""SELECT n.symbol_id, n.as_of, n."window", {aggs} FROM ends n LEFT JOIN (SELECT * FROM {table} WHERE {where}) t ON t.symbol_id = n.symbol_id AND t.{ts} > n.start_time AND t.{ts} <= n.as_of
  GROUP BY n.symbol_id, n.as_of, n."window" """


_METRICS = f"""funding AS ({_over("ticks", "snapshot_time", f"{_avg('funding_rate')} AS funding_avg, min(funding_rate) AS funding_min, max(funding_rate) AS funding_max", "NOT failed")}),
taker AS ({_over("flows", "snapshot_time", f"coalesce({_sum('buy - sell')}, 0.0) AS taker_delta", "NOT failed")}),
liqs AS ({_over("liq", "bucket_time", f"coalesce({_sum('total_liquidation_usd')}, 0.0) AS liquidation_sum_usd")}),
bas AS ({_over("basis", "snapshot_time", f"{_avg('basis_percent')} AS basis_avg, min(basis_percent) AS basis_min, max(basis_percent) AS basis_max", "NOT failed")}),
cvd_at AS (SELECT symbol_id, as_of, {_sum("cvd_value")} AS cvd FROM ({_asof("cvd", "t.exchange, t.cvd_value", "NOT t.failed", "instants")}) GROUP BY symbol_id, as_of),
metrics AS (SELECT n.symbol_id, n.as_of, n."window", n.start_time, coalesce(a.cvd, 0.0) - coalesce(b.cvd, 0.0) AS cvd_change, funding_avg, funding_min, funding_max, taker_delta, liquidation_sum_usd, basis_avg, basis_min, basis_max
  FROM ends n JOIN funding USING (symbol_id, as_of, "window") JOIN taker USING (symbol_id, as_of, "window") JOIN liqs USING (symbol_id, as_of, "window") JOIN bas USING (symbol_id, as_of, "window")
  LEFT JOIN cvd_at a ON a.symbol_id = n.symbol_id AND a.as_of = n.as_of LEFT JOIN cvd_at b ON b.symbol_id = n.symbol_id AND b.as_of = n.start_time)"""
_METRIC_PARTS = (_TICKS, _GRID, _FLOWS, _CVD, _LIQ, _BASIS, _ENDS, _METRICS)

_STRUCT = """s AS (SELECT g.symbol_id, g.as_of, w."window" AS period, count(c.close) AS candles, arg_min(c.close, c.open_time) AS fc, arg_max(c.close, c.open_time) AS lc, max(c.high) AS high, min(c.low) AS low,
  list_sort(list_distinct(list(c.low))) AS lows, list_reverse_sort(list_distinct(list(c.high))) AS highs
  FROM grid g CROSS JOIN windows w LEFT JOIN candles c ON c.symbol_id = g.symbol_id AND c.open_time >= g.as_of - w.w AND c.open_time <= g.as_of GROUP BY g.symbol_id, g.as_of, w."window"),
m AS (SELECT *, candles >= 2 AS enough, coalesce((lc - fc) / nullif(fc, 0) * 100, 0.0) AS change, coalesce((high - low) / nullif(lc, 0) * 100, 0.0) AS wide FROM s)"""

SQL: dict[str, str] = {}

SQL["venue_asof_latest"] = _with(_TICKS, _GRID, _latest()) + "SELECT symbol_id, as_of, exchange, snapshot_time, last_price, open_interest FROM latest"
SQL["latest_ticks"] = _with(_TICKS) + "SELECT symbol_id, exchange, max(snapshot_time) AS snapshot_time, arg_max(last_price, snapshot_time) AS last_price FROM ticks GROUP BY symbol_id, exchange"
SQL["aggregate_snapshot"] = _with(_TICKS, _GRID, _latest(), _AGG) + "SELECT * FROM agg"
SQL["raw_by_exchange"] = (
    _with(_TICKS, _GRID6, _latest())
    + """SELECT symbol_id, as_of, string_agg(exchange, ',' ORDER BY exchange) AS venues,
  string_agg('{"k": ' || k || ', "status": "ok"}', ';' ORDER BY exchange) AS payloads FROM latest WHERE NOT failed GROUP BY symbol_id, as_of"""
)
SQL["enrichment"] = (
    _with(_TICKS, _GRID, _FLOWS, _CVD, _LIQ, _BASIS)
    + f"""SELECT g.symbol_id, g.as_of, coalesce(b, 0.0) AS total_taker_buy_volume, coalesce(s, 0.0) AS total_taker_sell_volume, coalesce(d, 0.0) AS total_buy_sell_delta, coalesce(c, 0.0) AS total_cvd, avg_basis_percent,
  coalesce(l, 0.0) AS long_liquidation_usd, coalesce(sh, 0.0) AS short_liquidation_usd, coalesce(t, 0.0) AS total_liquidation_usd FROM grid g
LEFT JOIN (SELECT symbol_id, as_of, {_sum("buy")} AS b, {_sum("sell")} AS s, {_sum("buy - sell")} AS d FROM ({_asof("flows", "t.exchange, t.buy, t.sell")}) GROUP BY ALL) USING (symbol_id, as_of)
LEFT JOIN (SELECT symbol_id, as_of, {_sum("cvd_value")} AS c FROM ({_asof("cvd", "t.exchange, t.cvd_value")}) GROUP BY ALL) USING (symbol_id, as_of)
LEFT JOIN (SELECT symbol_id, as_of, {_avg("basis_percent")} AS avg_basis_percent FROM ({_asof("basis", "t.exchange, t.basis_percent")}) GROUP BY symbol_id, as_of) USING (symbol_id, as_of)
LEFT JOIN (SELECT g.symbol_id, g.as_of, {_sum("long_liquidation_usd")} AS l, {_sum("short_liquidation_usd")} AS sh, {_sum("total_liquidation_usd")} AS t FROM grid g JOIN liq ON liq.symbol_id = g.symbol_id
  AND bucket_time >= as_of - INTERVAL 5 MINUTE AND bucket_time <= as_of GROUP BY g.symbol_id, g.as_of) USING (symbol_id, as_of)"""
)
_BOOKS = "books AS (SELECT symbol_id, exchange, ts AS snapshot_time, (k - 50) * 3.0 AS imbalance, CASE WHEN k = 9 THEN -value ELSE value * 10 END AS bid, value * 7 AS ask FROM e)"
_BOOK_SUMS = f"""book_sums AS (SELECT symbol_id, as_of, {_avg("imbalance")} AS avg_imbalance_percent, {_sum("greatest(bid, 0)")} AS total_bid_depth_usd, {_sum("ask")} AS total_ask_depth_usd
  FROM ({_asof("books", "t.exchange, t.imbalance, t.bid, t.ask")}) GROUP BY symbol_id, as_of)"""
SQL["enrichment_book"] = (
    _with(_TICKS, _GRID, _BOOKS, _BOOK_SUMS)
    + "SELECT symbol_id, as_of, avg_imbalance_percent, coalesce(total_bid_depth_usd, 0.0) AS total_bid_depth_usd, coalesce(total_ask_depth_usd, 0.0) AS total_ask_depth_usd FROM (SELECT DISTINCT * FROM grid) LEFT JOIN book_sums USING (symbol_id, as_of)"
)
SQL["point_aggregate"] = _with(_TICKS, _GRID, _latest(), _POINT) + "SELECT * FROM point"
SQL["market_point_change"] = (
    _with(_TICKS, _GRID, _ENDS, _latest("instants"), _POINT)
    + """SELECT n.symbol_id, n.as_of, n."window", a.price - b.price AS price_change, round((a.price - b.price) / nullif(b.price, 0) * 100, 6) AS price_change_pct, a.volume - b.volume AS volume_change,
  a.open_interest - b.open_interest AS oi_change FROM ends n LEFT JOIN point a ON a.symbol_id = n.symbol_id AND a.as_of = n.as_of LEFT JOIN point b ON b.symbol_id = n.symbol_id AND b.as_of = n.start_time"""
)
SQL["window_metrics"] = _with(*_METRIC_PARTS) + "SELECT * FROM metrics"
SQL["anomaly_flags"] = (
    _with(*_METRIC_PARTS)
    + """SELECT symbol_id, as_of, "window", 'large_liquidation_cluster' AS name, 'info' AS severity, liquidation_sum_usd AS value FROM metrics WHERE liquidation_sum_usd >= 100000
UNION ALL SELECT symbol_id, as_of, "window", 'elevated_basis', 'info', basis_avg FROM metrics WHERE abs(basis_avg) >= 0.5
UNION ALL SELECT symbol_id, as_of, "window", 'positive_funding_extreme', 'info', funding_max FROM metrics WHERE funding_max >= 0.004
UNION ALL SELECT symbol_id, as_of, "window", 'negative_funding_extreme', 'info', funding_min FROM metrics WHERE funding_min <= -0.004"""
)
SQL["exchange_divergence"] = (
    _with(_TICKS, _GRID, _latest())
    + """, v AS (SELECT *, CASE WHEN last_price > 0 THEN last_price END AS price FROM latest WHERE NOT failed),
d AS (SELECT symbol_id, as_of, count(*) AS exchange_count, min(price) AS price_min, max(price) AS price_max, min(open_interest) AS oi_min, max(open_interest) AS oi_max, min(funding_rate) AS funding_min,
  max(funding_rate) AS funding_max, min(volume_24h) AS volume_min, max(volume_24h) AS volume_max, arg_min(exchange, (price, exchange)) AS weakest_exchange, arg_min(exchange, (-price, exchange)) AS strongest_exchange
  FROM v GROUP BY symbol_id, as_of HAVING count(*) >= 2)
SELECT *, (price_max - price_min) / nullif(price_min, 0) * 100 AS price_spread_percent, (oi_max - oi_min) / nullif(oi_min, 0) * 100 AS oi_spread_percent, funding_max - funding_min AS funding_spread,
  (volume_max - volume_min) / nullif(volume_min, 0) * 100 AS volume_spread_percent, price_max - price_min AS divergence_abs, coalesce((price_max - price_min) / nullif(price_min, 0) * 10000, 0.0) AS divergence_bps FROM d"""
)
SQL["venue_candles"] = _with(_EVENTS, _KLINES, _CANDLES) + "SELECT * FROM candles"


def _roll(source: str, name: str, unit: str) -> str:
    return f"""{name} AS (SELECT symbol_id, exchange, arg_max(source_symbol, (open_time, close_time)) AS source_symbol, time_bucket(INTERVAL {unit}, open_time, TIMESTAMP '1970-01-01') AS bucket, max(close_time) AS close_time,
  arg_min(open_price, (open_time, close_time)) AS open_price, max(high_price) AS high_price, min(low_price) AS low_price, arg_max(close_price, (open_time, close_time)) AS close_price, {_sum("volume")} AS volume,
  {_sum("quote_volume")} AS quote_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, count(*) AS source_rows FROM {source} GROUP BY symbol_id, exchange, time_bucket(INTERVAL {unit}, open_time, TIMESTAMP '1970-01-01')),
{name}_k AS (SELECT * EXCLUDE (bucket, source_rows), bucket AS open_time FROM {name})"""


SQL["kline_rollup"] = _with(_EVENTS, _KLINES, _roll("klines", "r15", "15 MINUTE"), _roll("r15_k", "r60", "1 HOUR"), _roll("r60_k", "r240", "4 HOUR"), _roll("r240_k", "r1d", "1 DAY")) + "SELECT * EXCLUDE (bucket), bucket AS open_time FROM r1d"
SQL["weekly_bars"] = f"""WITH b AS (SELECT l_suppkey AS symbol_id, l_returnflag || l_linestatus AS exchange, l_shipdate AS open_time, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice / l_quantity) AS place FROM lineitem)
SELECT symbol_id, exchange, CAST(date_trunc('week', open_time) AS TIMESTAMP) AS week, arg_min(price, place) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, place) AS close_price, {_sum("volume", 2)} AS volume,
  count(*) AS source_rows FROM b GROUP BY ALL"""
SQL["rollup_probe"] = _with(_EVENTS, _KLINES) + "SELECT coalesce(min(open_time), TIMESTAMP '2024-01-15') AS window_start, count(*) AS row_count FROM klines WHERE open_time < TIMESTAMP '2024-01-15'"
SQL["market_structure"] = (
    _with(_TICKS, _GRID6, _KLINES, _CANDLES, _WINDOWS, _STRUCT)
    + """SELECT symbol_id, as_of, period, candles, CASE WHEN NOT enough THEN 'unknown' WHEN change > 0.2 THEN 'bullish' WHEN change < -0.2 THEN 'bearish' ELSE 'sideways' END AS trend_direction,
  CASE WHEN NOT enough THEN 'unknown' WHEN wide < 1 THEN 'compression' WHEN wide > 5 OR abs(change) > 3 THEN 'expansion' ELSE 'ranging' END AS structure_state, CASE WHEN enough THEN high END AS last_swing_high,
  CASE WHEN enough THEN low END AS last_swing_low, round(CASE WHEN enough AND high > low THEN (lc - low) / (high - low) * 100 END, 6) AS price_position, round(CASE WHEN enough THEN change END, 6) AS price_change_percent,
  round(CASE WHEN enough THEN wide END, 6) AS range_percent, CASE WHEN NOT enough THEN 'insufficient_candles' END AS reason FROM m"""
)
SQL["support_resistance"] = (
    _with(_TICKS, _GRID6, _KLINES, _CANDLES, _WINDOWS, _STRUCT)
    + """SELECT symbol_id, as_of, period, CASE WHEN enough THEN lows[1] END AS support_1, CASE WHEN enough THEN lows[2] END AS support_2, CASE WHEN enough THEN lows[3] END AS support_3,
  CASE WHEN enough THEN highs[1] END AS resistance_1, CASE WHEN enough THEN highs[2] END AS resistance_2, CASE WHEN enough THEN highs[3] END AS resistance_3 FROM m"""
)
# levels that lie 1e-9 from one another, of coarse prices with tiny differences
_OFF = "list_filter({0}, lambda x: abs(x - {0}[1]) >= 1e-9)"
SQL["near_equal_levels"] = (
    _with(_TICKS, _GRID6, _KLINES, _CANDLES, _WINDOWS)
    + f""", c AS (SELECT symbol_id, open_time, close, floor(low / 100) + 1 + tiny AS low, floor(high / 100) + 1 + tiny AS high FROM (SELECT *, epoch_us(open_time) // 300000000 % 60 * 3e-11::DOUBLE AS tiny FROM candles)),
x AS (SELECT g.symbol_id, g.as_of, w."window" AS period, count(c.close) >= 2 AS enough, list_sort(list(c.low)) AS l1, list_reverse_sort(list(c.high)) AS h1
  FROM grid g CROSS JOIN windows w LEFT JOIN c ON c.symbol_id = g.symbol_id AND c.open_time >= g.as_of - w.w AND c.open_time <= g.as_of GROUP BY ALL),
y AS (SELECT *, {_OFF.format("l1")} AS l2, {_OFF.format("h1")} AS h2 FROM x)
SELECT symbol_id, as_of, period, CASE WHEN enough THEN l1[1] END AS support_1, CASE WHEN enough THEN l2[1] END AS support_2, CASE WHEN enough THEN {_OFF.format("l2")}[1] END AS support_3,
  CASE WHEN enough THEN h1[1] END AS resistance_1, CASE WHEN enough THEN h2[1] END AS resistance_2, CASE WHEN enough THEN {_OFF.format("h2")}[1] END AS resistance_3 FROM y"""
)
SQL["volatility"] = (
    _with(_TICKS, _GRID6, _KLINES, _CANDLES, _WINDOWS)
    + f""", x AS (SELECT g.symbol_id, g.as_of, w."window" AS period, c.*  EXCLUDE (symbol_id), lag(c.close) OVER (PARTITION BY g.symbol_id, g.as_of, w."window" ORDER BY c.open_time) AS p
  FROM grid g CROSS JOIN windows w LEFT JOIN candles c ON c.symbol_id = g.symbol_id AND c.open_time >= g.as_of - w.w AND c.open_time <= g.as_of),
y AS (SELECT symbol_id, as_of, period, count(close) AS candles, max(high) AS high_price, min(low) AS low_price, arg_max(close, open_time) AS close_price,
  {_avg("CASE WHEN close IS NOT NULL THEN greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) END")} AS atr, stddev_samp(ln(close / p)) AS sd, count(p) AS n FROM x GROUP BY symbol_id, as_of, period),
d AS (SELECT symbol_id, as_of, (high_price - low_price) / nullif(close_price, 0) * 100 AS r24 FROM y WHERE period = '24h'), z AS (SELECT symbol_id, as_of, (high_price - low_price) / nullif(close_price, 0) * 100 AS r7 FROM y WHERE period = '7d')
SELECT y.symbol_id, y.as_of, period, candles, high_price, low_price, close_price, atr, round(CASE WHEN n >= 2 THEN sd * sqrt(n) END, 6) AS realized_volatility,
  CASE WHEN candles > 0 THEN r24 END AS range_percent_24h, CASE WHEN candles > 0 THEN r7 END AS range_percent_7d FROM y JOIN d USING (symbol_id, as_of) JOIN z USING (symbol_id, as_of)"""
)
SQL["taker_fill"] = _with(_EVENTS, _FLOWS) + "SELECT symbol_id, exchange, snapshot_time, buy AS taker_buy_volume, sell AS taker_sell_volume, buy - sell AS buy_sell_delta, CAST(NULL AS DOUBLE) AS buy_sell_delta_quote, buy / nullif(sell, 0) AS buy_sell_ratio, buy - sell AS best_delta FROM flows"
SQL["basis_fill"] = _with(_EVENTS, _BASIS) + "SELECT symbol_id, exchange, snapshot_time, round(futures_price - index_price, 6) AS basis, round(futures_price - index_price, 6) AS basis_value, round((futures_price - index_price) / nullif(index_price, 0) * 100, 6) AS basis_percent FROM basis"
SQL["cumulative_delta"] = (
    _with(_EVENTS, _FLOWS, _CVD)
    + """SELECT symbol_id, exchange, period, snapshot_time, cvd_value, buy - sell AS cvd_delta, buy - sell AS cvd_change, round(CASE WHEN previous <> 0 THEN (buy - sell) / previous * 100 ELSE 0.0 END, 6) AS cvd_change_percent,
  buy AS buy_volume, sell AS sell_volume FROM cvd"""
)
_LIQ_OUT = "SELECT *, '5m' AS period, long_liquidation_usd AS long_liquidation_notional, short_liquidation_usd AS short_liquidation_notional, total_liquidation_usd AS total_liquidation_notional FROM liq"
SQL["liquidation_buckets"] = _with(_EVENTS, _LIQ) + _LIQ_OUT
SQL["liquidation_totals"] = _with(_EVENTS, _LIQ) + "SELECT symbol_id, exchange, bucket_time, long_liquidation_usd, short_liquidation_usd, round(long_liquidation_usd + short_liquidation_usd, 4) AS total_liquidation_usd, round(long_liquidation_usd + short_liquidation_usd, 4) AS total_liquidation_notional FROM liq"
SQL["large_liquidations"] = (
    _with(_EVENTS)
    + """SELECT CAST(event_id AS VARCHAR) AS event_key, symbol_id, exchange, ts AS event_time, CASE exchange WHEN 'purchase' THEN 'long' WHEN 'error' THEN 'short' ELSE 'unknown' END AS side, round(value * (k + 1), 4) AS usd_value
  FROM e WHERE value * (k + 1) >= 1000"""
)
SQL["derived_open_interest"] = _with(_TICKS) + "SELECT symbol_id, exchange, source_symbol, snapshot_time, open_interest, CAST(NULL AS DOUBLE) AS open_interest_value FROM ticks"
SQL["derived_funding"] = _with(_TICKS) + "SELECT symbol_id, exchange, source_symbol, snapshot_time, funding_rate, CAST(NULL AS DOUBLE) AS mark_price, CAST(NULL AS DOUBLE) AS index_price FROM ticks"
_SPOILED = """spoiled AS (SELECT event_id, symbol_id, CASE WHEN k = 3 THEN ' ' ELSE exchange END AS exchange, CASE WHEN k = 5 THEN snapshot_time + INTERVAL 400 DAY ELSE snapshot_time END AS snapshot_time,
  CASE WHEN k = 7 THEN 0.25 ELSE funding_rate END AS funding_rate, CASE WHEN k IN (7, 11) THEN -last_price ELSE last_price END AS last_price FROM ticks),
judged AS (SELECT *, CASE WHEN NOT coalesce(symbol_id > 0, false) THEN 'invalid_source|symbol_id must be positive' WHEN trim(exchange) = '' THEN 'invalid_source|exchange is required'
  WHEN snapshot_time > TIMESTAMP '2024-01-31' + INTERVAL 2 MINUTE THEN 'future_timestamp|snapshot_time lies in the future' WHEN abs(funding_rate) > 0.05 THEN 'funding_outlier|funding_rate is implausible'
  WHEN last_price < 0 THEN 'invalid_value|last_price must not be negative' END AS issue FROM spoiled)"""
SQL["quarantine_valid"] = _with(_TICKS, _SPOILED) + "SELECT event_id, symbol_id, exchange, snapshot_time, last_price, funding_rate FROM judged WHERE issue IS NULL"
SQL["quarantine_issues"] = (
    _with(_TICKS, _SPOILED)
    + """SELECT symbol_id, exchange, 'market_snapshot' AS data_type, split_part(issue, '|', 1) AS issue_type, split_part(issue, '|', 2) AS error, 'warning' AS severity, count(*) AS issues
  FROM judged WHERE issue IS NOT NULL GROUP BY ALL"""
)
SQL["kline_gaps"] = (
    _with(_EVENTS, _KLINES, _GAPS)
    + """SELECT symbol_id, exchange, gap_start, gap_end, 'kline' AS data_type, '5m' AS period,
  sha1(symbol_id || '|' || exchange || '|kline|5m|' || strftime(gap_start, '%Y-%m-%dT%H:%M:%SZ') || '|' || strftime(gap_end, '%Y-%m-%dT%H:%M:%SZ')) AS gap_key FROM gaps"""
)
SQL["stale_latest"] = _with(_TICKS) + "SELECT symbol_id, exchange, max(snapshot_time) AS gap_start, TIMESTAMP '2024-01-30 22:00:00' AS gap_end, 'stale_latest' AS detector FROM ticks GROUP BY symbol_id, exchange HAVING max(snapshot_time) < TIMESTAMP '2024-01-30 21:00:00'"
_STALE = """SELECT symbol_id, exchange, source_symbol, '{0}' AS data_type, max(snapshot_time) AS gap_start, TIMESTAMP '2024-01-30 22:00:00' AS gap_end, {1} AS expected_interval_seconds, 'stale_latest' AS detector
  FROM {2} GROUP BY symbol_id, exchange, source_symbol HAVING max(snapshot_time) < TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 1 SECOND * {1} * 2"""
SQL["stale_sources"] = _with(_TICKS, _GRID, _latest(), _AGG) + " UNION ALL ".join(
    [_STALE.format("ticker", 1800, "ticks"), _STALE.format("open_interest", 3600, "(SELECT * FROM ticks WHERE exchange <> 'view')"), _STALE.format("funding", 7200, "ticks"), _STALE.format("aggregated_snapshot", 300, "(SELECT symbol_id, 'aggregate' AS exchange, CAST(NULL AS VARCHAR) AS source_symbol, as_of AS snapshot_time FROM agg)")]
)
SQL["coverage_gaps"] = (
    _with(_TICKS)
    + """, slots AS (SELECT symbol_id, exchange, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00:00', INTERVAL 1 HOUR)) AS slot_time FROM (SELECT DISTINCT symbol_id, exchange FROM ticks))
SELECT symbol_id, exchange, 'ticker' AS data_type, slot_time, exchange || ':' || symbol_id || ':ticker:1h:' || CAST(epoch(slot_time) AS BIGINT) AS slot_key FROM slots
  WHERE (symbol_id, exchange, slot_time) NOT IN (SELECT (symbol_id, exchange, date_trunc('hour', snapshot_time)) FROM ticks)"""
)
SQL["coverage_runs"] = (
    _with(_TICKS)
    + """, slots AS (SELECT symbol_id, exchange, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00:00', INTERVAL 1 HOUR)) AS h FROM (SELECT DISTINCT symbol_id, exchange FROM ticks)),
missing AS (SELECT * FROM slots WHERE (symbol_id, exchange, h) NOT IN (SELECT (symbol_id, exchange, date_trunc('hour', snapshot_time)) FROM ticks)),
islands AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY symbol_id, exchange ORDER BY h) AS island FROM missing)
SELECT symbol_id, exchange, 'ticker' AS data_type, min(h) AS first_hour, max(h) AS last_hour, count(*) AS hours FROM islands GROUP BY symbol_id, exchange, island"""
)
SQL["backfill_slots"] = (
    _with(_EVENTS, _KLINES, _GAPS)
    + """, x AS (SELECT symbol_id, exchange, CAST(floor(epoch(gap_start) / 3600) AS BIGINT) AS lo, CAST(ceil(epoch(gap_end) / 3600) AS BIGINT) - 1 AS hi FROM gaps),
y AS (SELECT symbol_id, exchange, unnest(range(lo, least(hi, lo + 5) + 1)) * 3600 AS sec FROM x)
SELECT symbol_id, exchange, CAST(to_timestamp(sec) AT TIME ZONE 'UTC' AS TIMESTAMP) AS slot_time, 'low' AS priority, 'backfill:' || exchange || ':' || symbol_id || ':kline:5m:' || sec AS slot_key FROM y"""
)
SQL["overview_page"] = (
    _with(_TICKS, _GRID, _latest(), _AGG, _SYMBOLS)
    + """, o AS (SELECT s.symbol_id, s.symbol, s.rank, a.as_of AS snapshot_time, a.total_volume_24h, coalesce(a.price_weighted, a.price_avg) AS display_price,
  CASE WHEN a.as_of IS NULL THEN 'unknown' WHEN TIMESTAMP '2024-01-31' < a.as_of THEN 'future' WHEN TIMESTAMP '2024-01-31' - a.as_of > INTERVAL 15 MINUTE THEN 'stale' WHEN TIMESTAMP '2024-01-31' - a.as_of > INTERVAL 5 MINUTE THEN 'lagging' ELSE 'fresh' END AS freshness
  FROM symbols s LEFT JOIN (SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY as_of DESC) = 1) a USING (symbol_id) WHERE s.is_active AND s.n_markets >= 2 AND s.rank >= 1)
SELECT *, (SELECT count(*) FROM o) AS total_count FROM o ORDER BY total_volume_24h DESC NULLS LAST, symbol LIMIT 12"""
)
_PARTS = """symbols AS (SELECT CAST(p_partkey AS BIGINT) AS symbol_id, 'P' || p_partkey AS symbol, 'B' || (p_partkey % 50) AS base_asset, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 1000 AS INTEGER) END AS rank,
  p_partkey % 7 <> 0 AS is_active, p_partkey % 5 + 1 AS n_markets FROM part)"""
SQL["top_symbols"] = _with(_PARTS) + "SELECT symbol_id, symbol, rank FROM symbols WHERE is_active ORDER BY rank ASC NULLS LAST, symbol LIMIT 15"
SQL["symbol_resolve"] = (
    _with(_PARTS)
    + """, l AS (SELECT ' p' || l_partkey AS lookup FROM lineitem UNION SELECT 'b' || (l_partkey % 50) FROM lineitem),
names AS (SELECT upper(symbol) AS alias, * FROM symbols UNION SELECT upper(base_asset), * FROM symbols)
SELECT lookup, symbol_id, symbol FROM (SELECT l.lookup, s.*, row_number() OVER (PARTITION BY lookup ORDER BY is_active DESC, rank ASC NULLS LAST, symbol) AS rn FROM l JOIN names s ON upper(trim(l.lookup)) = s.alias) WHERE rn = 1"""
)
SQL["watchlist_symbols"] = _with(_SYMBOLS) + "SELECT symbol_id, symbol FROM symbols WHERE symbol_id IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)"
SQL["symbol_markets"] = (
    _with(_PARTS)
    + """SELECT symbol_id, symbol, v AS exchange, 'perp' AS market_type, 'S' || symbol_id AS source_symbol FROM (SELECT *, unnest(range(1, n_markets + 1)) AS i, ['binance', 'okx', 'bybit', 'gate', 'other'][i] AS v FROM symbols) WHERE v <> 'other'"""
)
SQL["series_page"] = (
    _with(_TICKS)
    + """, f AS (SELECT * FROM ticks WHERE symbol_id = 3 AND exchange = 'view' AND snapshot_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')
SELECT symbol_id, exchange, snapshot_time, last_price, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY snapshot_time DESC LIMIT 20 OFFSET 10"""
)
SQL["deep_page"] = _with(_TICKS) + "SELECT event_id, symbol_id, snapshot_time, (SELECT count(*) FROM ticks) AS total_count FROM ticks ORDER BY snapshot_time, event_id LIMIT 200 OFFSET 700"
SQL["kline_page"] = _with(_EVENTS, _KLINES) + "SELECT symbol_id, exchange, open_time, close_price, (SELECT count(*) FROM klines WHERE symbol_id = 4) AS total_count FROM klines WHERE symbol_id = 4 ORDER BY open_time, symbol_id, exchange LIMIT 25"
SQL["expire_rows"] = _with(_TICKS) + "SELECT event_id, symbol_id, snapshot_time FROM ticks WHERE snapshot_time < TIMESTAMP '2024-01-15' ORDER BY snapshot_time, event_id LIMIT 2500"
SQL["eligible_count"] = _with(_EVENTS, _KLINES) + "SELECT count(*) AS eligible_rows FROM klines WHERE open_time < TIMESTAMP '2024-01-15'"
SQL["rollup_expire"] = _with(_EVENTS, _KLINES) + "SELECT symbol_id, exchange, open_time, close_price FROM klines WHERE open_time >= TIMESTAMP '2024-01-15'"
SQL["expired_partitions"] = """WITH w AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS d, strftime(o_orderdate, '%G_W%V') AS iso FROM orders)
SELECT DISTINCT strftime(o_orderdate, 'orders_%Y_%m') AS name, CAST(m AS DATE) AS range_start, CAST(m + INTERVAL 1 MONTH AS DATE) AS range_end FROM w WHERE m + INTERVAL 1 MONTH <= TIMESTAMP '1995-06-15'
UNION SELECT DISTINCT 'Orders_' || iso, CAST(d AS DATE), CAST(d + INTERVAL 7 DAY AS DATE) FROM w WHERE o_orderkey % 2 = 0 AND d + INTERVAL 7 DAY <= TIMESTAMP '1995-06-15'"""
SQL["health_summary"] = (
    _with(_TICKS)
    + """, h AS (SELECT CASE WHEN exchange = 'error' THEN 'unknown' ELSE exchange END AS exchange, snapshot_time, CASE WHEN k % 17 = 0 THEN 'unhealthy' WHEN k % 13 = 0 THEN 'degraded' ELSE 'healthy' END AS s FROM ticks)
SELECT exchange, max(snapshot_time) AS last_heartbeat_at, count(*) AS collectors, count(*) FILTER (WHERE s = 'healthy') AS healthy, count(*) FILTER (WHERE s = 'degraded') AS degraded, count(*) FILTER (WHERE s = 'unhealthy') AS unhealthy,
  CASE WHEN bool_or(s = 'unhealthy') THEN 'unhealthy' WHEN bool_or(s = 'degraded') THEN 'degraded' ELSE 'healthy' END AS status FROM h GROUP BY exchange"""
)
SQL["request_metrics"] = (
    _with(_TICKS)
    + f"""SELECT exchange, 'type' || (symbol_id % 3) AS request_type, CASE k % 10 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN CASE WHEN k % 20 = 2 THEN 'timeout' ELSE 'unknown' END ELSE '200' END AS status,
  count(*) AS requests, {_avg("last_price", 2)} AS avg_duration_ms, count(*) FILTER (WHERE k % 10 = 0) AS rate_limited FROM ticks WHERE snapshot_time >= TIMESTAMP '2024-01-29' GROUP BY ALL"""
)
SQL["request_errors"] = (
    _with(_TICKS)
    + """SELECT exchange, x.t AS error_type, x.r AS recoverable, x.l AS rate_limited, count(*) AS requests FROM (SELECT exchange, CASE WHEN k % 10 = 0 THEN {'t': 'rate_limited', 'r': true, 'l': true} WHEN k % 10 = 1 THEN {'t': 'server_error', 'r': true, 'l': false}
  WHEN k % 20 = 2 THEN {'t': 'timeout', 'r': true, 'l': false} WHEN k % 10 = 2 THEN {'t': 'network_error', 'r': true, 'l': false} END AS x FROM ticks) GROUP BY ALL"""
)
SQL["status_counts"] = "SELECT o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY ALL"
SQL["open_counts"] = "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open_issues, count(*) FILTER (WHERE o_orderstatus = 'P') AS open_gaps, (SELECT CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) FROM lineitem) AS rows_deleted FROM orders"
SQL["upsert_klines"] = (
    _with(_EVENTS, _KLINES)
    + """SELECT symbol_id, exchange, source_symbol, '5m' AS "interval", open_time, round(open_price, 4) AS open_price, high_price, low_price, round(close_price + a, 4) AS close_price, round(volume + 2 * a, 4) AS volume, quote_volume
  FROM (SELECT *, CASE WHEN exchange IN ('click', 'view') THEN 1 ELSE 0 END AS a FROM klines)"""
)
SQL["insert_absent"] = _with(_TICKS) + "SELECT event_id, exchange, CASE WHEN event_id % 2 = 1 THEN last_price ELSE 0.0 END AS last_price FROM ticks"
_VENUE = "p AS (SELECT *, ['binance', 'okx', 'bybit', 'bitget', 'gate', 'mexc'][event_id % 6 + 1] AS venue FROM e)"
SQL["normalize_ticker"] = _with(_EVENTS, _VENUE) + f"SELECT venue AS exchange, symbol_id, count(*) AS \"rows\", {_sum('value', 2)} AS price_sum, {_sum('k', 2)} AS oi_sum, max(CASE WHEN venue = 'gate' THEN ts ELSE date_trunc('millisecond', ts) END) AS newest FROM p GROUP BY ALL"
SQL["normalize_kline"] = (
    _with(_EVENTS, _VENUE)
    + f"""SELECT venue AS exchange, symbol_id, count(*) AS "rows", {_sum("value", 2)} AS open_sum, {_sum("1.5", 2)} AS low_sum, {_sum("value", 2)} AS close_sum, {_sum("k", 2)} AS volume_sum,
  min(date_trunc(CASE WHEN venue IN ('gate', 'mexc') THEN 'second' ELSE 'millisecond' END, ts)) AS first_open FROM p GROUP BY ALL"""
)
SQL["orderbook_imbalance"] = (
    _with(_EVENTS, _VENUE)
    + """, b AS (SELECT venue, symbol_id, ts, value AS v, value * k + value AS bn, (value + 1) * 2 AS an, (value + (value + 1)) / 2 AS mid FROM p)
SELECT venue AS exchange, symbol_id, ts AS snapshot_time, round(bn, 4) AS bid_notional, round(an, 4) AS ask_notional, round(mid, 4) AS mid_price, round(((v + 1) - v) / mid * 10000, 4) AS spread_bps, round((bn - an) / (bn + an), 4) AS imbalance_ratio FROM b"""
)
SQL["venue_errors"] = (
    _with(_EVENTS, _VENUE)
    + """SELECT venue AS exchange, CASE venue WHEN 'binance' THEN 'code -1121' WHEN 'okx' THEN 'code 50011' WHEN 'bybit' THEN 'code 10006' WHEN 'bitget' THEN 'code 40034' WHEN 'gate' THEN 'label TOO_FAST' ELSE 'code 510' END AS error,
  count(*) AS payloads FROM p WHERE symbol_id % 2 = 0 GROUP BY ALL"""
)
SQL["health_filters"] = _with(_TICKS) + "SELECT symbol_id, count(*) FILTER (WHERE failed AND symbol_id % 2 = 1) AS shallow_bad, count(*) FILTER (WHERE failed) AS deep_bad FROM ticks GROUP BY symbol_id"
_KEYED = """kinds AS (SELECT kind || ':' || exchange || ':' || source_symbol AS key, kind, symbol_id, exchange, snapshot_time, CASE WHEN kind = 'market' THEN last_price END AS last_price, CASE WHEN kind = 'open_interest' THEN open_interest END AS open_interest,
  CASE WHEN kind = 'funding' THEN funding_rate END AS funding_rate FROM ticks CROSS JOIN (VALUES ('market'), ('open_interest'), ('funding')) v(kind))"""
SQL["stream_latest"] = _with(_TICKS, _KEYED) + "SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY key ORDER BY snapshot_time DESC) = 1"
SQL["stream_buckets"] = _with(_TICKS, _KEYED) + "SELECT key, date_trunc('hour', snapshot_time) AS bucket_time, max(snapshot_time) AS snapshot_time, arg_max(last_price, snapshot_time) AS last_price FROM kinds WHERE kind = 'market' GROUP BY ALL"
SQL["stream_liquidations"] = _with(_EVENTS, _LIQ) + "SELECT * FROM liq"
SQL["stream_dedupe"] = _with(_EVENTS) + "SELECT symbol_id, exchange, count(*) AS events FROM e GROUP BY ALL"
SQL["stream_lag"] = (
    _with(_TICKS)
    + """, r AS (SELECT exchange, snapshot_time AS t, snapshot_time + INTERVAL 1 SECOND * (k - 20) AS r FROM ticks)
SELECT exchange, max(t) AS last_event_at, max(r) AS last_received_at, greatest(0, epoch_us(max(r)) - epoch_us(arg_max(t, r))) / 1000000.0 AS lag_seconds, TIMESTAMP '2024-01-30' - max(r) > INTERVAL 30 SECOND AS is_stale FROM r GROUP BY exchange"""
)
SQL["fresh_or_fallback"] = (
    _with(_TICKS, _KEYED)
    + """, m AS (SELECT * FROM kinds WHERE kind = 'market'), b AS (SELECT key, arg_max(last_price, snapshot_time) AS p, max(snapshot_time) AS t FROM m WHERE snapshot_time < TIMESTAMP '2024-01-29' GROUP BY key),
l AS (SELECT key, arg_max(last_price, snapshot_time) AS p, max(snapshot_time) AS t FROM m GROUP BY key HAVING max(snapshot_time) > TIMESTAMP '2024-01-29 12:00:00'),
j AS (SELECT b.key, b.p AS bp, b.t AS bt, l.p AS lp, l.t AS lt, coalesce(TIMESTAMP '2024-01-30 12:00:00' - l.t <= INTERVAL 12 HOUR, false) AS fresh FROM b LEFT JOIN l USING (key))
SELECT key, CASE WHEN fresh THEN lp ELSE bp END AS last_price, CASE WHEN fresh THEN lt ELSE bt END AS snapshot_time, CASE WHEN fresh THEN 'realtime' ELSE 'database' END AS source FROM j"""
)

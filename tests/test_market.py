"""Literal cases of the market operators, and boundary cases of times and health."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.functions import scalars as fn
from marketlens.operators import aggregates, asof, candles, derive, gaps, ops, retention, serve, sinks, trailing, validate
from marketlens.options import DAY, HOUR, MINUTE, AnalyticsOptions, ListOptions
from marketlens.sources import payloads

T = dt.datetime(2024, 3, 1, 12, 0)
TICK = "symbol_id long, exchange string, source_symbol string, snapshot_time timestamp, last_price double, mark_price double, volume_24h double, quote_volume_24h double, open_interest double, funding_rate double, raw_data string"


def at(minutes=0.0, **kw):
    return T + dt.timedelta(minutes=minutes, **kw)


def tick(venue, minutes, price, raw='{"status": "ok"}', mark=None, volume=1.0, quote=2.0, oi=3.0, funding=0.0001, **kw):
    return (1, venue, "BTC", at(minutes, **kw), price, mark, volume, quote, oi, funding, raw)


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(1, T)], "symbol_id long, as_of timestamp")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_asof_bounds_are_closed_and_ties_are_settled(spark, grid):
    facts = [tick("edge", -10, 1.0), tick("old", -10, 1.0, microseconds=-1), tick("now", 0, 2.0), tick("late", 0, 3.0, microseconds=1), tick("two", -1, 4.0), tick("two", -2, 5.0)]
    got = asof.asof_latest(spark.createDataFrame(facts, TICK), grid, "snapshot_time", 10 * MINUTE)
    assert {r["exchange"]: r["last_price"] for r in rows(got)} == {"edge": 1.0, "now": 2.0, "two": 4.0}


def test_asof_across_spans(spark):
    facts = spark.createDataFrame([tick("a", 0, 7.0)], TICK)
    grid = spark.createDataFrame([(1, T + dt.timedelta(hours=h)) for h in range(0, 30)], "symbol_id long, as_of timestamp")
    assert asof.asof_latest(facts, grid, "snapshot_time", DAY).count() == 25


def test_window_stats_leave_out_the_start(spark, grid):
    facts = spark.createDataFrame([(1, at(-60), 1.0), (1, at(-60) + dt.timedelta(microseconds=1), 2.0), (1, T, 4.0), (1, T + dt.timedelta(microseconds=1), 8.0)], "symbol_id long, ts timestamp, v double")
    got = rows(trailing.window_stats(facts, grid, "ts", {"1h": HOUR}, {"s": trailing.total(F.col("v"))}))
    assert got[0]["s"] == 6.0
    got = rows(trailing.window_stats(facts, grid, "ts", {"1h": HOUR}, {"s": trailing.total(F.col("v"))}, closed=True))
    assert got[0]["s"] == 7.0


def _plain_levels(values, reverse):
    kept = []
    for v in sorted(values, reverse=reverse):
        if not kept or abs(kept[-1] - v) >= 1e-9:
            kept.append(v)
    return kept[:3]


@pytest.mark.parametrize("step", [1e-11, 4e-11, 3e-10, 1e-9, 0.25])
@pytest.mark.parametrize("bases", [(1.0, 1.1, 1.2), (1e-8, 2e-8, 5e-8), (7.0,)])
def test_levels_skip_near_equal_values(spark, grid, step, bases):
    """Sixty candles in groups within a billionth, over many minutes: as a plain scan of all sorted values has it."""
    lows = [bases[k % len(bases)] + (k * 7 % 20) * step for k in range(60)]
    facts = spark.createDataFrame([(1, at(-3 * k), v) for k, v in enumerate(lows)], "symbol_id long, ts timestamp, v double")
    stats = {"lows": trailing.levels(F.col("v"), largest=False), "highs": trailing.levels(F.col("v"), largest=True)}
    got = {r["window"]: r for r in rows(trailing.window_stats(facts, grid, "ts", {"30m": 30 * MINUTE, "4h": 4 * HOUR, "1m": MINUTE}, stats, closed=True))}
    for window, n in (("1m", 1), ("30m", 11), ("4h", 60)):
        assert (got[window]["lows"], got[window]["highs"]) == (_plain_levels(lows[:n], False), _plain_levels(lows[:n], True))


def test_levels_of_nothing(spark, grid):
    facts = spark.createDataFrame([(1, at(-5), None), (2, at(-5), 1.0)], "symbol_id long, ts timestamp, v double")
    assert [r["s"] for r in rows(trailing.window_stats(facts, grid, "ts", {"1h": HOUR}, {"s": trailing.levels(F.col("v"), largest=False)}))] == [[]]


_BOOK = "symbol_id long, exchange string, source_symbol string, requested_symbol string, snapshot_time timestamp, depth_levels int, spread_bps double, bid_depth_1pct_usd double, mark_price double, spot_price double, period string, interval string"


def _verdicts(spark, record, requested_period=None, **fields):
    row = {"symbol_id": 1, "exchange": "a", "source_symbol": "S", "requested_symbol": None, "snapshot_time": T, "depth_levels": 5, "spread_bps": 1.0, "bid_depth_1pct_usd": 1.0, "mark_price": 1.0, "spot_price": 1.0, "period": "1h", "interval": "1h"} | fields
    names = [x.split(" ")[0] for x in _BOOK.split(", ")]
    df = spark.createDataFrame([tuple(row[n] for n in names)], _BOOK)
    return [r["error"] for r in rows(validate.quarantine(df, record, T, requested_period=requested_period)[1])]


def test_what_was_asked_for(spark):
    """Symbols and periods are compared in their case without white space, and blank asks for nothing."""
    for asked, bad in ((" S\t", False), ("s", True), (" ", False), (None, False), ("S2", True)):
        assert _verdicts(spark, "cvd", requested_symbol=asked) == (["source_symbol is not the requested one"] if bad else [])
    for period, asked, want in ((" 1h ", "1h", []), (None, "1h", ["period is not the requested one"]), ("1h", " ", []), (None, None, []), ("x y", None, ["malformed period in period"]), ("1H", "1h", ["period is not the requested one"])):
        assert _verdicts(spark, "cvd", asked, period=period) == want
    assert _verdicts(spark, "basis", "5m") == []


def test_every_depth_and_price_is_looked_at(spark):
    assert _verdicts(spark, "basis", mark_price=-3.0) == ["mark_price must not be negative"]
    assert _verdicts(spark, "basis", spot_price=-4.0) == ["spot_price must not be negative"]
    assert _verdicts(spark, "orderbook", bid_depth_1pct_usd=-1.0) == ["bid_depth_1pct_usd must not be negative"]
    assert _verdicts(spark, "orderbook", spread_bps=-1.0) == []
    assert _verdicts(spark, "open_interest_history", period=" \n") == ["period is required"]


def test_degraded_newest_row_removes_the_venue(spark, grid):
    bad = '{"a": {"quality_status": "Degraded"}}'
    facts = [tick("a", -1, 10.0), tick("b", -1, 20.0), tick("c", -2, 30.0), tick("c", -1, 31.0, bad)]
    r = rows(aggregates.aggregate_snapshot(spark.createDataFrame(facts, TICK), grid))[0]
    assert (r["exchange_count"], r["price_avg"], r["available_exchanges"], r["skipped_exchanges"]) == (2, 15.0, ["a", "b"], ["c"])


def test_aggregate_fields(spark, grid):
    facts = [tick("a", -1, 10.0, quote=1.0, oi=2.0), tick("b", -1, None, mark=30.0, quote=3.0, oi=-1.0, volume=-5.0), tick("c", -1, 0.0, mark=99.0, oi=4.0, funding=None)]
    r = rows(aggregates.aggregate_snapshot(spark.createDataFrame(facts, TICK), grid))[0]
    assert r["price_avg"] == 20.0 and r["price_weighted"] == (10 + 90) / 4
    assert r["total_volume_24h"] == 2.0 and r["total_open_interest"] == 6.0 and r["total_open_interest_value"] == 20.0
    assert r["invalid_fields"] == ["b:open_interest", "b:volume_24h", "c:price"]
    assert rows(aggregates.exchange_divergence(spark.createDataFrame(facts[:1], TICK), grid)) == []
    d = rows(aggregates.exchange_divergence(spark.createDataFrame(facts, TICK), grid))[0]
    assert (d["price_min"], d["price_max"], d["weakest_exchange"], d["strongest_exchange"], d["divergence_bps"], d["exchange_count"]) == (10.0, 30.0, "a", "b", 20000.0, 3)


def test_cvd_falls_back_to_an_older_healthy_row(spark, grid):
    cvd = spark.createDataFrame([(1, "a", "5m", at(-3), 5.0, "{}"), (1, "a", "5m", at(-1), 9.0, '{"status": "failed"}')], "symbol_id long, exchange string, period string, snapshot_time timestamp, cvd_value double, raw_data string")
    assert rows(aggregates.cvd_at(cvd, grid))[0]["cvd"] == 5.0


@pytest.mark.parametrize(
    ("raw", "bad"),
    [('{"x": {"quality_status": "degraded"}}', True), ('{"Status" : " FAILED "}', True), ('{"failed": true}', True), ('{"failed": false}', False), ('{"status": "degrading"}', False), ("not json status: failed", False), (None, False), ('{"note": "status failed"}', False)],
)
def test_deep_health(spark, raw, bad):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(fn.deep_degraded("raw")).first()[0] is bad


def test_window_metrics_against_a_model(spark):
    import random

    rng = random.Random(4)
    facts = [tick(rng.choice("ab"), -rng.randint(0, 3000) / 10, rng.randint(1, 99) / 1.0, rng.choice(["{}", "{}", '{"status":"failed"}'])) for _ in range(120)]
    seen, unique = set(), []
    for f in facts:
        if (f[1], f[3]) not in seen:
            seen.add((f[1], f[3]))
            unique.append(f)
    instants = [at(-m) for m in (0, 37, 120)]
    grid = spark.createDataFrame([(1, t) for t in instants], "symbol_id long, as_of timestamp")
    options = AnalyticsOptions(max_age=20 * MINUTE, windows={"1h": HOUR}, sum_scale=6)
    got = {r["as_of"]: r for r in rows(aggregates.window_metrics({"ticks": spark.createDataFrame(unique, TICK)}, grid, options))}

    def price(t):
        newest = {}
        for f in unique:
            if t - dt.timedelta(minutes=20) <= f[3] <= t and (f[1] not in newest or f[3] > newest[f[1]][3]):
                newest[f[1]] = f
        ok = [f[4] for f in newest.values() if "failed" not in f[10]]
        return sum(ok) / len(ok) if ok else None

    for t in instants:
        a, b = price(t), price(t - dt.timedelta(hours=1))
        assert got[t]["price_change"] == (None if a is None or b is None else a - b)


def test_anomaly_flags(spark, grid):
    metrics = grid.withColumns({"window": F.lit("1h"), "liquidation_sum_usd": F.lit(2e6), "basis_avg": F.lit(1.25), "funding_max": F.lit(0.002), "funding_min": F.lit(0.0)})
    book = grid.withColumn("avg_imbalance_percent", F.lit(-55.0))
    assert sorted(r["name"] for r in rows(aggregates.anomaly_flags(metrics, book))) == ["elevated_basis", "large_liquidation_cluster", "orderbook_imbalance", "positive_funding_extreme"]


CANDLE = "symbol_id long, open_time timestamp, open double, high double, low double, close double"


def test_market_structure(spark, grid):
    c = spark.createDataFrame([(1, at(-15), 100.0, 101.0, 99.0, 100.0), (1, at(-10), 100.0, 105.0, 100.0, 104.0), (1, at(-5), 104.0, 109.0, 103.0, 108.0)], CANDLE)
    got = {r["period"]: r for r in rows(candles.market_structure(c, grid))}
    r = got["15m"]
    assert (r["trend_direction"], r["structure_state"], r["last_swing_high"], r["candles"]) == ("bullish", "expansion", 109.0, 3)
    assert r["price_position"] == 90.0 and r["support_levels"] == [99.0, 100.0, 103.0] and r["resistance_levels"] == [109.0, 105.0, 101.0]
    assert (got["5m"]["trend_direction"], got["5m"]["reason"], got["5m"]["support_levels"]) == ("unknown", "insufficient_candles", [])


def test_levels_closer_than_a_billionth_are_one(spark, grid):
    c = spark.createDataFrame([(1, at(-k), 1.0, 2.0, low, 1.5) for k, low in enumerate([1.0, 1.0 + 1e-10, 1.25, 1.5])], CANDLE)
    assert rows(candles.market_structure(c, grid))[0]["support_levels"] == [1.0, 1.25, 1.5]


def test_volatility_restarts_in_each_window(spark, grid):
    c = spark.createDataFrame([(1, at(-20), 1.0, 500.0, 1.0, 500.0), (1, at(-15), 100.0, 105.0, 95.0, 100.0), (1, at(-10), 100.0, 110.0, 98.0, 108.0), (1, at(-5), 108.0, 115.0, 105.0, 112.0)], CANDLE)
    for scale in (None, 6):
        r = {x["period"]: x for x in rows(candles.volatility(c, grid, scale=scale))}["15m"]
        assert r["atr"] == pytest.approx((10 + 12 + 10) / 3)
        import math
        import statistics

        logs = [math.log(108 / 100), math.log(112 / 108)]
        assert r["realized_volatility"] == pytest.approx(statistics.stdev(logs) * math.sqrt(2))
        assert r["range_percent_24h"] == pytest.approx(499 / 112 * 100)


def test_rollup_aligns_the_cutoff_and_keeps_order(spark):
    schema = "symbol_id long, exchange string, source_symbol string, interval string, open_time timestamp, close_time timestamp, open_price double, high_price double, low_price double, close_price double, volume double, quote_volume double, trade_count long, is_closed boolean, raw_data string"
    k = spark.createDataFrame([(1, "a", "S", "5m", at(5 * i), at(5 * i + 4), 1.0 + i, 9.0 + i, 0.5, 2.0 + i, 1.0, 1.0, 2, True, "{}") for i in range(7)], schema)
    got = rows(candles.rollup_klines(k, "5m", at(32)))
    assert [(r["open_time"], r["open_price"], r["close_price"], r["high_price"], r["volume"], r["trade_count"], r["source_rows"]) for r in sorted(got, key=lambda r: r["open_time"])] == [(T, 1.0, 4.0, 11.0, 3.0, 6, 3), (at(15), 4.0, 7.0, 14.0, 3.0, 6, 3)]
    rolled, kept, expired = retention.rollup_then_expire(k, "5m", at(32))
    assert (rolled.count(), kept.count(), expired.count()) == (2, 1, 6)


def test_fills(spark):
    d = "double"
    flow = spark.createDataFrame([(10.0, 4.0, 1000.0, 250.0, None, None, None)], ", ".join(f"{c} {d}" for c in ("taker_buy_volume", "taker_sell_volume", "taker_buy_quote_volume", "taker_sell_quote_volume", "buy_sell_delta", "buy_sell_delta_quote", "buy_sell_ratio")))
    r = rows(derive.fill_taker_flow(flow))[0]
    assert (r["buy_sell_delta"], r["buy_sell_delta_quote"], r["buy_sell_ratio"]) == (6.0, 750.0, 2.5)
    basis = spark.createDataFrame([(105.0, 100.0, None, None, None)], ", ".join(f"{c} {d}" for c in ("futures_price", "index_price", "basis", "basis_value", "basis_percent")))
    r = rows(derive.fill_basis(basis))[0]
    assert (r["basis"], r["basis_value"], r["basis_percent"]) == (5.0, 5.0, 5.0)


LIQ = "event_key string, symbol_id long, exchange string, source_symbol string, event_time timestamp, side string, price double, quantity double, notional double, usd_value double, raw_data string"


def test_liquidation_usd_and_buckets(spark):
    e = spark.createDataFrame([("k", 1, "a", "S", at(3, seconds=42), "long", 100.0, 12.0, None, None, "{}"), ("z", 0, "a", "S", at(3), "long", 1.0, 1.0, None, None, "{}")], LIQ)
    assert rows(derive.liquidation_usd(e))[0]["usd_value"] == 1200.0
    big = e.withColumn("usd_value", F.lit(2500.0))
    r = rows(derive.liquidation_buckets(big, tier="all"))
    assert len(r) == 1 and (r[0]["period"], r[0]["bucket_time"], r[0]["total_liquidation_usd"], r[0]["long_liquidation_count"]) == ("5m", T, 2500.0, 1)
    assert rows(derive.liquidation_buckets(big, tier="top"))[0]["bucket_time"] == at(3)


def test_quarantine_splits(spark):
    t = spark.createDataFrame([tick("a", 10, 1.0), tick("b", -1, 1.0, funding=0.25), tick("c", -1, -1.0), tick("d", -1, 1.0)], TICK)
    valid, issues = validate.quarantine(t, "market_snapshot", T)
    assert [r["exchange"] for r in rows(valid)] == ["d"]
    assert {r["exchange"]: r["issue_type"] for r in rows(issues)} == {"a": "future_timestamp", "b": "funding_outlier", "c": "invalid_value"}


def test_validators(spark):
    e = spark.createDataFrame([(None, 1, "a", "S", T, "long", 1.0, 2.0, None, None, "{}")], LIQ)
    valid, _ = validate.quarantine(e, "liquidation_event", T)
    assert rows(valid)[0]["event_key"].startswith("liq:")
    book = spark.createDataFrame([(1, "a", "S", T, 0, 1.0)], "symbol_id long, exchange string, source_symbol string, snapshot_time timestamp, depth_levels int, mid_price double")
    assert "depth_levels" in rows(validate.quarantine(book, "orderbook", T)[1])[0]["error"]
    flow = spark.createDataFrame([(1, "a", "S", T, "5 minutes", 1.0)], "symbol_id long, exchange string, source_symbol string, snapshot_time timestamp, period string, taker_buy_volume double")
    assert "malformed period" in rows(validate.quarantine(flow, "taker_flow", T)[1])[0]["error"]
    assert validate.quarantine(flow.withColumn("period", F.lit("Min5")), "taker_flow", T)[0].count() == 1
    assert rows(validate.quarantine(flow.withColumn("period", F.lit("1h")), "taker_flow", T, requested_period="5m")[1])[0]["issue_type"] == "interval_mismatch"


def test_upserts_are_idempotent(spark):
    schema = "symbol_id long, exchange string, interval string, open_time timestamp, open_price double, source_symbol string, close_price double"
    old = spark.createDataFrame([(1, "a", "5m", T, 1.0, "S", 2.0)], schema)
    new = spark.createDataFrame([(1, "a", "5m", T, 7.0, "X", 8.0), (1, "a", "5m", at(5), 3.0, "S", 4.0)], schema)
    once = sinks.upsert_klines(old, new)
    assert sorted((r["open_price"], r["source_symbol"], r["close_price"]) for r in rows(once)) == [(1.0, "S", 8.0), (3.0, "S", 4.0)]
    assert sorted(map(tuple, sinks.upsert_klines(once, new).collect())) == sorted(map(tuple, once.collect()))
    health = "collector string, exchange string, heartbeat_at timestamp, last_success_at timestamp, last_error_at timestamp, last_error string"
    h = sinks.upsert_health(spark.createDataFrame([("c", "a", at(0), at(0), None, None)], health), spark.createDataFrame([("c", "a", at(5), None, at(5), "e")], health))
    assert rows(h)[0] == {"collector": "c", "exchange": "a", "heartbeat_at": at(5), "last_success_at": at(0), "last_error_at": at(5), "last_error": "e"}
    issue = "issue_key string, status string, first_seen_at timestamp, last_seen_at timestamp"
    i = sinks.upsert_issues(spark.createDataFrame([("x", "resolved", at(0), at(0)), ("y", "resolved", at(0), at(0))], issue), spark.createDataFrame([("x", "open", at(5), at(5))], issue))
    assert {r["issue_key"]: (r["status"], r["first_seen_at"], r["last_seen_at"]) for r in rows(i)} == {"x": ("open", at(0), at(5)), "y": ("resolved", at(0), at(0))}
    gap = "gap_key string, gap_end timestamp, detected_at timestamp, backfill_status string"
    g = sinks.upsert_gaps(spark.createDataFrame([("g", at(1), at(2), "done")], gap), spark.createDataFrame([("g", at(3), at(4), "pending")], gap))
    assert (rows(g)[0]["backfill_status"], rows(g)[0]["gap_end"]) == ("done", at(3))


def test_partition_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", 1.0), (2, "2024-01-02", 2.0)], "id long, day string, v double")
    path, keys = str(tmp_path / "t"), ["id", "day"]
    merge = lambda a, b: sinks.upsert(a, b, keys)
    sinks.write_partitions(spark, df, path, "day", merge, str(tmp_path / "s"))
    sinks.write_partitions(spark, df.where("id = 2").withColumn("v", F.lit(9.0)), path, "day", merge, str(tmp_path / "s"))
    assert sorted((r["id"], r["v"]) for r in rows(spark.read.parquet(path))) == [(1, 1.0), (2, 9.0)]


def test_gaps_and_backfill(spark):
    k = spark.createDataFrame([(1, "a", "S", "5m", at(m)) for m in (0, 5, 15, 40)], "symbol_id long, exchange string, source_symbol string, interval string, open_time timestamp")
    g = gaps.kline_gaps(k, "5m", 300, DAY, at(60))
    assert [(r["gap_start"], r["gap_end"]) for r in rows(g)] == [(at(15), at(40))]
    slots = rows(gaps.backfill_slots(g))
    assert sorted(r["slot_time"] for r in slots) == [at(m) for m in (15, 20, 25, 30, 35)] and len({r["slot_key"] for r in slots}) == 5
    assert gaps.backfill_slots(g, 2).count() == 2 and gaps.backfill_slots(g, lag_seconds=100, pause_above=50).count() == 0
    assert gaps.stale_latest(spark.createDataFrame([(1, at(0))], "symbol_id long, snapshot_time timestamp"), "aggregated_snapshot", 60, at(5)).count() == 1


def test_expiry_partitions_input(spark):
    t = spark.createDataFrame([(i, at(i)) for i in range(10)], "id long, ts timestamp")
    kept, gone = retention.expire(t, "ts", at(6), max_rows=4, keys=("id",))
    assert sorted(r["id"] for r in rows(gone)) == [0, 1, 2, 3] and kept.count() == 6
    names = spark.createDataFrame([("a_2024_01",), ("a_2024_02",), ("a_2024_w05",), ("a_2024_w09",), ("a_2024_13",), ("plain",)], "name string")
    got = {r["name"]: (str(r["range_start"]), str(r["range_end"])) for r in rows(retention.expired_partitions(names, "2024-02-15"))}
    assert got == {"a_2024_01": ("2024-01-01", "2024-02-01"), "a_2024_w05": ("2024-01-29", "2024-02-05")}


def test_lists(spark):
    t = spark.createDataFrame([tick("a", -m, float(m)) for m in range(10)], TICK)
    got = rows(serve.list_series(t, "market", ListOptions(symbol_id=1, limit=3, offset=2)))
    assert [r["last_price"] for r in got] == [2.0, 3.0, 4.0] and {r["total_count"] for r in got} == {10}
    assert serve.list_series(t, "market", ListOptions(offset=50)).count() == 0


PAY = payloads.RAW_SCHEMA


def test_tickers_of_three_venues(spark):
    raw = [
        ("binance", "ticker", 1, "S", None, T, '{"lastPrice":"1.23","askPrice":"1.24","indexPrice":"1.229","closeTime":1700000000000}'),
        ("gate", "ticker", 1, "S", None, T, '[{"last":"1.23","lowest_ask":"1.24","index_price":"1.229"}]'),
        ("bybit", "ticker", 1, "S", None, T, '{"retCode":0,"time":1700000000000,"result":{"list":[{"lastPrice":"1.23","ask1Price":"1.24","indexPrice":"1.229"}]}}'),
        ("bybit", "ticker", 1, "S", None, T, '{"retCode":10001,"result":{}}'),
        ("okx", "ticker", 1, "S", None, T, "oops"),
    ]
    df = spark.createDataFrame(raw, PAY)
    got = rows(payloads.market_snapshots(df))
    assert {(r["exchange"], r["last_price"], r["ask_price"], r["index_price"]) for r in got} == {(v, 1.23, 1.24, 1.229) for v in ("binance", "gate", "bybit")}
    assert {r["exchange"]: r["snapshot_time"] == T for r in got} == {"binance": False, "gate": True, "bybit": False}
    assert sorted(r["error"] for r in rows(payloads.rejected(df))) == ["code 10001", "malformed payload"]


def test_other_payloads(spark):
    raw = [
        ("okx", "taker_flow", 1, "S", "5m", T, '{"code":"0","data":[["1700000000000","4","10"]]}'),
        ("gate", "open_interest", 1, "S", "5m", T, "[[1700000000, 5.5],[1700000300, 6]]"),
        ("bitget", "long_short_ratio", 1, "S", "5m", T, '{"code":"00000","data":[{"longRatio":"0.6","shortRatio":"0.4","ts":"1700000000000"}]}'),
        ("binance", "basis", 1, "S", "5m", T, '[{"futuresPrice":"105","indexPrice":"100","basis":"5","basisRate":"0.05","timestamp":1700000000000}]'),
        ("gate", "liquidation", 1, "S", None, T, '[{"contract":"S","size":-3,"price":"10","time":1700000000}]'),
        ("okx", "liquidation", 1, "S", None, T, '{"code":"0","data":[{"posSide":"long","bkPx":"10","sz":"2","ts":"1700000000000"}]}'),
    ]
    df = spark.createDataFrame(raw, PAY)
    f = rows(payloads.taker_flows(df))[0]
    assert (f["taker_buy_volume"], f["taker_sell_volume"], f["buy_sell_delta"], f["buy_sell_ratio"]) == (10.0, 4.0, 6.0, 2.5)
    assert sorted(r["open_interest"] for r in rows(payloads.open_interest(df))) == [5.5, 6.0]
    assert rows(payloads.long_short_ratios(df))[0]["long_short_ratio"] == pytest.approx(1.5)
    assert rows(payloads.basis_premiums(df))[0]["basis_percent"] == pytest.approx(5.0)
    assert {(r["exchange"], r["side"], r["usd_value"]) for r in rows(payloads.liquidation_events(df))} == {("gate", "buy", 30.0), ("okx", "sell", 20.0)}


def test_symbol_markets(spark):
    def m(venue, symbol, status="active"):
        return f'{{"exchange":"{venue}","market_type":"perp","source_symbol":"{symbol}","status":"{status}"}}'

    markets = "[" + ",".join([m(v, "S") for v in payloads.VENUES] + [m("binance", " "), m("kraken", "S"), m("okx", "D", "delisted")]) + "]"
    assert payloads.symbol_markets(spark.createDataFrame([(1, "BTC", markets)], "symbol_id long, symbol string, markets string")).count() == 6


def test_health_and_errors(spark):
    h = spark.createDataFrame([("a", T, "healthy"), ("a", at(1), "degraded"), (None, T, "healthy")], "exchange string, heartbeat_at timestamp, status string")
    assert {r["exchange"]: r["status"] for r in rows(ops.exchange_health(h))} == {"a": "degraded", "unknown": "healthy"}
    log = spark.createDataFrame([(429, None), (503, None), (None, "i/o timeout"), (200, None)], "status_code int, error_message string")
    assert [r["error_type"] for r in rows(ops.classify_requests(log))] == ["rate_limited", "server_error", "timeout", None]

"""Pages found through time buckets, and whole aggregate records, against plain models."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import aggregates, gaps, serve, sinks
from marketlens.options import DAY, HOUR, AnalyticsOptions, ListOptions

T = dt.datetime(2024, 3, 1, 12, 0)


@pytest.fixture(scope="module")
def moments(spark):
    """Times of all distances, with many ties and some that are missing."""
    rng = random.Random(7)
    steps = [dt.timedelta(days=9), dt.timedelta(hours=1), dt.timedelta(seconds=3), dt.timedelta(microseconds=2), dt.timedelta(0)]
    rows, at = [], T - dt.timedelta(days=700)
    for n in range(400):
        at += rng.choice(steps)
        rows.append((n, None if n % 40 == 0 else at))
    return rows, spark.createDataFrame(rows, "id long, at timestamp").repartition(5).cache()


@pytest.mark.parametrize("few", [0, 50, 10_000])
@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("offset", [0, 5, 203, 388, 395, 400])
def test_pages_at_any_depth(moments, descending, offset, few):
    rows, df = moments
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] and -r[1].timestamp(), r[0]) if descending else (r[1] is not None, r[1] and r[1].timestamp(), r[0]))
    got = serve.page_by_time(df, "at", ["id"], ListOptions(descending=descending, offset=offset, limit=20), few=few).collect()
    assert [r["id"] for r in got] == [r[0] for r in order[offset : offset + 20]]
    assert {r["total_count"] for r in got} <= {400}


def test_a_deep_page_leaves_few_rows_to_sort(moments):
    _, df = moments
    place = serve.find_page(df, "at", False, 300, 10, few=0)
    assert place.total == 400 and df.where(place.holds(df, "at")).count() < 40


def test_pages_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, at timestamp")
    assert serve.page_by_time(empty, "at", ["id"], ListOptions()).count() == 0
    untimed = spark.createDataFrame([(n, None) for n in range(5)], "id long, at timestamp")
    got = serve.page_by_time(untimed, "at", ["id"], ListOptions(offset=3), few=0).collect()
    assert [(r["id"], r["total_count"]) for r in got] == [(3, 5), (4, 5)]


def test_newest_rows_of_a_symbol(spark):
    t = spark.createDataFrame([(1, "a", T - dt.timedelta(minutes=m), m) for m in range(150)], "symbol_id long, exchange string, snapshot_time timestamp, m int")
    got = serve.symbol_detail(1, t, {"market": t}, limit=500)["market"].collect()
    assert [r["m"] for r in got] == list(range(100))  # a hundred rows at most


def test_stale_sources_are_known(spark):
    t = spark.createDataFrame([(1, T)], "symbol_id long, snapshot_time timestamp")
    with pytest.raises(ValueError, match="taker_flow"):
        gaps.stale_sources({"taker_flow": t}, {"taker_flow": 60}, str(T))
    (got,) = gaps.stale_sources({"aggregated_snapshot": t}, {"aggregated_snapshot": 60}, str(T + dt.timedelta(minutes=3))).collect()
    assert (got["exchange"], got["source_symbol"], got["data_type"]) == ("aggregate", None, "aggregated_snapshot")


TICK = "symbol_id long, exchange string, source_symbol string, snapshot_time timestamp, last_price double, mark_price double, volume_24h double, quote_volume_24h double, open_interest double, funding_rate double, raw_data string"


@pytest.fixture(scope="module")
def record(spark):
    at = T + dt.timedelta(microseconds=1500)
    ticks = [
        (1, "b", "S", T, 10.0, None, 1.0, 2.0, 3.0, 0.01, '{"k": 1}'),
        (1, 'a"q', "S", T, -1.0, None, -1.0, 2.0, -3.0, -0.02, None),
        (1, "c", "S", T, 10.0, None, 1.0, -2.0, 3.0, 0.5, '{"status": "failed"}'),
        (1, "x:y", "S", T, 12.0, None, 1.0, -2.0, None, None, "{}"),
    ]
    t = spark.createDataFrame(ticks, TICK)
    grid = spark.createDataFrame([(1, at)], "symbol_id long, as_of timestamp")
    book = spark.createDataFrame([(1, "b", T, 10, 80.0, -5.0, 6.0)], "symbol_id long, exchange string, snapshot_time timestamp, depth_levels int, imbalance_percent double, bid_depth_usd double, ask_depth_usd double")
    options = AnalyticsOptions(max_age=DAY, windows={"1h": HOUR, "24h": DAY})
    return aggregates.aggregate_records({"ticks": t, "funding": t.where("exchange = 'b'"), "orderbook": book}, grid, options).cache()


def test_json_of_an_aggregate(record):
    (r,) = record.collect()
    assert json.loads(r["available_exchanges"]) == ['a"q', "b", "x:y"]
    assert json.loads(r["raw_by_exchange"]) == {'a"q': {}, "b": {"k": 1}, "x:y": {}}
    assert json.loads(r["quality_metadata"]) == {
        "max_snapshot_age_seconds": 86400,
        "snapshot_time": "2024-03-01T12:00:00.0015Z",
        "stale_cutoff": "2024-02-29T12:00:00.0015Z",
        "included_exchanges": ['a"q', "b", "x:y"],
        "skipped_exchanges": {"c": ["degraded_raw_data"]},
        "invalid_fields": {'a"q': ["price", "volume_24h", "open_interest"], "x:y": ["quote_volume_24h"]},
    }
    windows = json.loads(r["window_metrics"])
    assert [w["window"] for w in windows] == ["1h", "24h"] and json.loads(r["metrics"]) == {"windows": windows}
    assert windows[0]["start_time"] == "2024-03-01T11:00:00.0015Z" and windows[0]["funding_avg"] == 0.01 and "basis_avg" not in windows[0] and "price_change" not in windows[0]
    assert windows[1]["quality"] == {"current_exchange_count": 3, "previous_exchange_count": 0, "max_snapshot_age_seconds": 86400}
    flags = json.loads(r["anomaly_flags"])
    assert [(f["name"], f.get("window")) for f in flags] == [("positive_funding_extreme", "1h"), ("positive_funding_extreme", "24h"), ("orderbook_imbalance", None)]
    assert (r["avg_imbalance_percent"], r["total_bid_depth_usd"], r["total_ask_depth_usd"]) == (80.0, 0.0, 6.0)


def test_aggregates_are_upserted_whole(record):
    once = sinks.upsert_aggregates(record, record.withColumns({"price_avg": F.lit(None).cast("double"), "metrics": F.lit(None).cast("string")}))
    (r,) = once.collect()
    assert r["price_avg"] is None and r["metrics"] == "{}" and r["weighted_price"] == r["price_weighted"] and r["raw_data"] == r["raw_by_exchange"]
    again = sinks.upsert_aggregates(once.drop("weighted_price", "raw_data"), once.drop("weighted_price", "raw_data"))
    assert again.select(*once.columns).collect() == [r]


def test_volatility_is_upserted_whole(spark):
    v = spark.createDataFrame([(1, "aggregate", "", "", "1h", T, 1.0, None)], "symbol_id long, exchange string, market_type string, source_symbol string, period string, snapshot_time timestamp, atr double, raw_data string")
    (r,) = sinks.upsert_volatility(v, v.withColumns({"atr": F.lit(None).cast("double"), "market_type": F.lit("perp")})).collect()
    assert (r["atr"], r["market_type"], r["source_symbol"], r["raw_data"]) == (None, "perp", None, "{}")

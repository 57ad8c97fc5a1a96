"""Streams over files give what the same operator gives on all rows at once."""

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import derive
from marketlens.sources import market
from marketlens.streaming import streams


def _files(df, path, n=3):
    df.repartitionByRange(n, df.columns[0]).write.parquet(path)


def _run(df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_latest_equals_batch(spark, sf, tmp_path):
    t = market.ticks(spark, sf)
    _files(t, str(tmp_path / "t"))
    live = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = _run(streams.latest_values(streams.keyed_events(live)), tmp_path, "complete", "latest")
    want = streams.latest_values(streams.keyed_events(t))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_equal_batch_up_to_the_watermark(spark, sf, tmp_path):
    e = market.liquidations(spark, sf)
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in _run(streams.liquidation_buckets(live, scale=6), tmp_path, "append", "buckets").collect()}
    want = {tuple(r) for r in streams.liquidation_buckets(e, scale=6).collect()}
    assert got <= want and len(got) > 0.9 * len(want)


def test_dedupe_and_running_delta(spark, sf, tmp_path):
    f = derive.fill_taker_flow(market.taker_flows(spark, sf)).where("symbol_id = 1")
    f.coalesce(1).write.parquet(str(tmp_path / "f"))
    live = spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))
    got = _run(streams.running_delta(live), tmp_path, "append", "delta")
    want = derive.cumulative_delta(f)
    on = ["symbol_id", "exchange", "period", "snapshot_time"]
    both = got.select(*on, F.col("cvd_value").alias("a")).join(want.select(*on, F.col("cvd_value").alias("b")), on)
    assert both.count() == want.count() and both.where("abs(a - b) > 1e-6").count() == 0
    e = market.liquidations(spark, sf).where("symbol_id = 2")
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "d"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "d"))
    assert _run(streams.dedupe_events(live, late="60 days"), tmp_path, "append", "dedupe").count() == e.count()


def test_bucket_flush_keeps_the_newest(spark):
    rows = [("k", "2024-01-01 00:00:10", 1.0), ("k", "2024-01-01 00:00:11", 2.0)]
    df = spark.createDataFrame(rows, "key string, t string, v double").withColumn("snapshot_time", F.col("t").cast("timestamp")).drop("t")
    got = streams.bucket_last(df).collect()
    assert len(got) == 1 and got[0]["v"] == 2.0 and str(got[0]["bucket_time"]) == "2024-01-01 00:00:00"


def test_ttl_and_fallback(spark):
    live = spark.createDataFrame([("a", "2024-01-01 00:09:50", 1.0), ("b", "2024-01-01 00:00:00", 2.0)], "key string, t string, v double").select("key", F.col("t").cast("timestamp").alias("snapshot_time"), "v")
    assert [r["key"] for r in streams.live_values(live, "2024-01-01 00:10:00").collect()] == ["a"]
    batch = live.withColumn("v", F.col("v") * 10)
    got = {r["key"]: (r["v"], r["source"]) for r in streams.fresh_or_fallback(live.select("key"), live, batch, "2024-01-01 00:10:00", "v").collect()}
    assert got == {"a": (1.0, "realtime"), "b": (20.0, "database")}


def test_lag(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:09", "2024-01-01 00:00:08")], "exchange string, e string, r string")
    df = df.select("exchange", F.col("e").cast("timestamp").alias("e"), F.col("r").cast("timestamp").alias("r"))
    got = {r["exchange"]: (r["lag_seconds"], r["is_stale"]) for r in streams.stream_lag(df, "e", "r", "2024-01-01 00:00:36").collect()}
    assert got == {"a": (5.0, True), "b": (0.0, False)}


def test_expiring_latest_drops_its_state(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 3, 1, 12, 0) + dt.timedelta(minutes=minutes)
    path = str(tmp_path / "files")
    schema = "key string, snapshot_time timestamp, price double"
    for k, rows in enumerate([[("a", at(0), 1.0), ("a", at(1), 2.0), ("b", at(0), 5.0)], [("b", at(120), 6.0)], [("b", at(121), 7.0)], [("c", at(122), 8.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = [(r["key"], r["action"], r["payload"]) for r in _run(streams.expiring_latest(live), tmp_path, "append", "expiring").collect()]
    assert ("a", "set", '{"price":2.0}') in got and ("a", "expire", '{"price":2.0}') in got
    assert [p for k, a, p in got if k == "b" and a == "set"][-1] == '{"price":7.0}' and ("c", "set", '{"price":8.0}') in got


def test_only_the_kinds_asked_for_are_made(spark, sf):
    t = market.ticks(spark, sf)
    got = streams.keyed_events(t, ("market",))
    assert sorted(map(str, got.collect())) == sorted(map(str, streams.keyed_events(t).where("kind = 'market'").collect()))


def test_upserted_aggregates_are_made_once(spark, sf):
    """The table and the batch are read from what was written, not each made from the events."""
    from marketlens.plans import records

    assert not [f for f in records.upsert_aggregates(spark, sf).inputFiles() if f.endswith("events.parquet")]

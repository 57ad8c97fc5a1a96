"""Latest values, buckets, dedup, running totals and freshness over streams.

Every function takes and gives streaming DataFrames; the same code runs on batch frames, which is how it is tested.
Event times bound the state: rows more than ``future`` ahead are dropped, and a watermark lets old state go. Rows that
come after the watermark are dropped, which a batch run would keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlens.functions.scalars import event_usd, micros
from marketlens.options import SECOND


def no_future(df: DataFrame, ts_col: str, skew_seconds: int = 120) -> DataFrame:
    return df.where(micros(ts_col) <= micros(F.current_timestamp()) + skew_seconds * SECOND)


def keyed_events(ticks: DataFrame, only: tuple[str, ...] = ("market", "open_interest", "funding")) -> DataFrame:
    """A tick as events of the kinds it carries (market, and open interest and funding where it has them), with their key;
    of ``only`` the kinds named, so that others are not made first."""
    kind = lambda name, cond: F.when(cond, F.struct(F.lit(name).alias("kind"), F.col("last_price").alias("last_price") if name == "market" else F.lit(None).cast("double").alias("last_price"), (F.col("open_interest") if name == "open_interest" else F.lit(None).cast("double")).alias("open_interest"), (F.col("funding_rate") if name == "funding" else F.lit(None).cast("double")).alias("funding_rate")))
    given = {"market": F.lit(True), "open_interest": F.col("open_interest").isNotNull(), "funding": F.col("funding_rate").isNotNull()}
    kinds = F.array_compact(F.array(*[kind(name, cond) for name, cond in given.items() if name in only]))
    out = ticks.select("symbol_id", "exchange", "source_symbol", "snapshot_time", F.explode(kinds).alias("k")).select("symbol_id", "exchange", "source_symbol", "snapshot_time", "k.*")
    return out.withColumn("key", F.concat_ws(":", "kind", F.lower(F.trim("exchange")), F.upper(F.trim("source_symbol"))))


def latest_values(events: DataFrame, ts_col: str = "snapshot_time") -> DataFrame:
    """Newest event of each key (output mode update or complete)."""
    rest = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(ts_col, F.xxhash64(*rest))).alias("v")).select("key", "v.*")


def live_values(latest: DataFrame, now, ttl_seconds: int = 600, ts_col: str = "snapshot_time") -> DataFrame:
    """Latest values that have not outlived their time; to be applied to the latest table at read time."""
    return latest.where(micros(ts_col) > micros(F.lit(now).cast("timestamp")) - ttl_seconds * SECOND)


#: What expiring_latest gives.
CHANGES = "key string, at timestamp, payload string, action string"


def expiring_latest(events: DataFrame, ttl_seconds: int = 600, ts_col: str = "snapshot_time", late: str = "10 minutes") -> DataFrame:
    """Changes of the newest event of each key (its other columns as JSON): set when a newer one comes, expire when the
    watermark has passed its time by so long. The state is one event a key, and goes with it."""
    rest = [c for c in events.columns if c not in ("key", ts_col)]
    e = events.withWatermark(ts_col, late).select("key", F.col(ts_col).alias("at"), F.to_json(F.struct(*rest)).alias("payload"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        change = lambda us, payload, action: pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(us, unit="us")], "payload": [payload], "action": [action]})
        if state.hasTimedOut:
            us, payload = state.get
            state.remove()
            yield change(us, payload, "expire")
            return
        newest = max((int(t.value // 1000), p) for f in frames for t, p in zip(f["at"], f["payload"], strict=True))
        if not state.exists or tuple(state.get) < newest:
            state.update(newest)
            yield change(*newest, "set")
        state.setTimeoutTimestamp(max(state.get[0] // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return e.groupBy("key").applyInPandasWithState(step, CHANGES, "us long, payload string", "append", GroupStateTimeout.EventTimeTimeout)


def bucket_last(events: DataFrame, ts_col: str = "snapshot_time", bucket: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Newest event of each key and tumbling bucket, stamped with the bucket's start (output mode append)."""
    rest = [c for c in events.columns if c != "key"]
    g = events.withWatermark(ts_col, late).groupBy(F.window(ts_col, bucket).alias("w"), "key").agg(F.max_by(F.struct(*rest), F.struct(ts_col, F.xxhash64(*rest))).alias("v"))
    return g.select(F.col("w.start").alias("bucket_time"), "key", "v.*")


def dedupe_events(events: DataFrame, ts_col: str = "event_time", late: str = "10 minutes", key: str = "event_key") -> DataFrame:
    """The first arrival of each event key."""
    out = events.withWatermark(ts_col, late)
    return out.dropDuplicatesWithinWatermark([key]) if events.isStreaming else out.dropDuplicates([key])


def liquidation_buckets(events: DataFrame, bucket: str = "5 minutes", late: str = "10 minutes", scale: int | None = None) -> DataFrame:
    """Liquidations per (symbol, venue, bucket) of event time (output mode append)."""
    long_ = F.coalesce(F.lower(F.trim("side")).isin("sell", "long"), F.lit(False))
    e = events.where("coalesce(symbol_id, 0) <> 0").withWatermark("event_time", late).withColumn("usd", event_usd()).withColumn("_long", long_)
    usd = F.col("usd") if scale is None else F.col("usd").cast(f"decimal(28,{scale})")
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    g = e.groupBy("symbol_id", "exchange", F.window("event_time", bucket).alias("w")).agg(F.count_if("_long").alias("long_liquidation_count"), F.count_if(~F.col("_long")).alias("short_liquidation_count"), total(F.when(F.col("_long"), usd)).alias("long_liquidation_usd"), total(F.when(~F.col("_long"), usd)).alias("short_liquidation_usd"), total(usd).alias("total_liquidation_usd"), F.greatest(F.lit(0.0), F.max("usd")).alias("largest_liquidation_usd"))
    return g.select("symbol_id", "exchange", F.col("w.start").alias("bucket_time"), *g.columns[3:])


#: What running_delta gives.
RUNNING_DELTA = "symbol_id long, exchange string, period string, snapshot_time timestamp, cvd_value double, cvd_change double, cvd_change_percent double"


def running_delta(flows: DataFrame, period_col: str = "period") -> DataFrame:
    """Cumulative taker delta per (symbol, venue, period): the state is one number a key. Rows of a batch are taken in
    order of time; a row that comes in a later batch adds to the total as it stands then."""
    f = flows.select("symbol_id", "exchange", F.col(period_col).alias("period"), "snapshot_time", F.coalesce("buy_sell_delta_quote", "buy_sell_delta").alias("change")).where("change is not null")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("snapshot_time", kind="stable")
        after = total + rows["change"].cumsum()
        state.update((float(after.iloc[-1]),))
        before = after - rows["change"]
        percent = (rows["change"] / before.where(before != 0) * 100).fillna(0.0)
        yield pd.DataFrame({"symbol_id": key[0], "exchange": key[1], "period": key[2], "snapshot_time": rows["snapshot_time"], "cvd_value": after, "cvd_change": rows["change"], "cvd_change_percent": percent})

    return f.groupBy("symbol_id", "exchange", "period").applyInPandasWithState(step, RUNNING_DELTA, "total double", "append", GroupStateTimeout.NoTimeout)


def stream_lag(events: DataFrame, ts_col: str, received_col: str, now, stale_seconds: int = 30) -> DataFrame:
    """Per venue: newest event and arrival, the lag of the newest arrival (never negative), and whether it went silent."""
    g = events.groupBy("exchange").agg(F.max(ts_col).alias("last_event_at"), F.max(received_col).alias("last_received_at"), F.max_by(ts_col, received_col).alias("_event"))
    lag = F.greatest(F.lit(0), micros("last_received_at") - micros("_event")) / SECOND
    return g.withColumn("lag_seconds", lag).withColumn("is_stale", micros(F.lit(now).cast("timestamp")) - micros("last_received_at") > stale_seconds * SECOND).drop("_event")


def fresh_or_fallback(keys: DataFrame, live: DataFrame, batch: DataFrame, now, value: str, ts_col: str = "snapshot_time", fresh_seconds: int = 30) -> DataFrame:
    """For each key the streamed value if it is fresh, else the batch value, tagged with where it came from."""
    now = micros(F.lit(now).cast("timestamp"))
    s = live.select("key", F.col(value).alias("_s"), F.col(ts_col).alias("_st"))
    b = batch.select("key", F.col(value).alias("_b"), F.col(ts_col).alias("_bt"))
    out = keys.select("key").distinct().join(s, "key", "left").join(b, "key", "left")
    fresh = F.coalesce(now - micros("_st") <= fresh_seconds * SECOND, F.lit(False))
    return out.select("key", F.when(fresh, F.col("_s")).otherwise(F.col("_b")).alias(value), F.when(fresh, F.col("_st")).otherwise(F.col("_bt")).alias(ts_col), F.when(fresh, "realtime").when(F.col("_bt").isNotNull(), "database").otherwise("none").alias("source"))

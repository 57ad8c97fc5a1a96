"""Missing data: gaps between rows, stale series, uncovered slots and the slots that would fill them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import gap_key, joined_key, micros, time_bucket
from marketlens.operators.asof import latest_by_key
from marketlens.options import DAY


def _as_gaps(df: DataFrame, data_type: str, period: str | None, seconds: int, detector: str) -> DataFrame:
    out = df.withColumns({"data_type": F.lit(data_type), "period": F.lit(period).cast("string"), "expected_interval_seconds": F.lit(seconds), "last_observed_at": F.col("gap_start"), "detector": F.lit(detector)})
    return out.withColumn("gap_key", gap_key())


def _before(df: DataFrame, keys: list[str], at: str, span: int, out: str) -> DataFrame:
    """df with the value of ``at`` (long) in the key's row before. Rows are taken span by span, and the last row of each
    span is carried into the next that has rows, so a long series is as many groups as it has spans."""
    c = df.withColumn("_span", F.floor(F.col(at) / span))
    ends = c.groupBy(*keys, "_span").agg(F.max(at).alias("_end"), F.min(at).alias("_begin"))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_span"))).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_span").alias("_of_span"), "_carried")
    inside = F.lag(at).over(Window.partitionBy(*keys, "_span").orderBy(at))
    on = F.col("_span") == F.col("_of_span")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return c.withColumn("_inside", inside).join(carried, on).withColumn(out, F.coalesce("_inside", "_carried")).drop("_span", "_inside", "_carried", "_of_span", *[f"_of_{k}" for k in keys])


def kline_gaps(klines: DataFrame, interval: str, expected_seconds: int, lookback: int, now) -> DataFrame:
    """Gaps of more than two intervals between neighbouring candles of a venue within the lookback (microseconds)."""
    now = F.lit(now).cast("timestamp")
    k = klines.where((F.col("interval") == interval) & (F.col("open_time") <= now) & (micros("open_time") >= micros(now) - lookback))
    k = _before(k.withColumn("_us", micros("open_time")), ["symbol_id", "exchange"], "_us", DAY, "_before")
    k = k.where(F.col("_us") - F.col("_before") > 2_000_000 * expected_seconds).withColumn("gap_start", F.timestamp_micros("_before"))
    return _as_gaps(k.select("symbol_id", "exchange", "source_symbol", "gap_start", F.col("open_time").alias("gap_end")), "kline", interval, expected_seconds, "kline_gap")


def stale_latest(facts: DataFrame, data_type: str, expected_seconds: int, now, ts_col: str = "snapshot_time") -> DataFrame:
    """Series whose newest row is older than two intervals. Tables without a venue are one series a symbol."""
    if "exchange" not in facts.columns:
        facts = facts.withColumn("exchange", F.lit("aggregate"))
    if "source_symbol" not in facts.columns:
        facts = facts.withColumn("source_symbol", F.lit(None).cast("string"))
    now = F.lit(now).cast("timestamp")
    newest = latest_by_key(facts.select("symbol_id", "exchange", "source_symbol", ts_col), ["symbol_id", "exchange"], ts_col, ("source_symbol",))
    stale = newest.where(micros(ts_col) < micros(now) - 2_000_000 * expected_seconds)
    return _as_gaps(stale.select("symbol_id", "exchange", "source_symbol", F.col(ts_col).cast("timestamp").alias("gap_start"), now.alias("gap_end")), data_type, None, expected_seconds, "stale_latest")


#: Data types that are looked at for stale series, each with its time column.
STALE_SOURCES = {"ticker": "snapshot_time", "market_snapshot": "snapshot_time", "open_interest": "snapshot_time", "funding": "snapshot_time", "aggregated_snapshot": "snapshot_time"}


def stale_sources(tables: Mapping[str, DataFrame], expected_seconds: Mapping[str, int], now) -> DataFrame:
    """Stale series of several tables, by data type."""
    unknown = sorted(set(tables) - set(STALE_SOURCES))
    if unknown:
        raise ValueError(f"unsupported stale data types: {', '.join(unknown)}")
    parts = [stale_latest(df, name, expected_seconds[name], now, STALE_SOURCES[name]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def coverage_slots(policies: DataFrame, markets: DataFrame, start, end) -> DataFrame:
    """Expected slots: each enabled policy (exchange, data_type, period, interval_seconds, priority) for each market of
    its venue, once an interval in ``[start, end)``, with an idempotency key."""
    p = policies.where("enabled") if "enabled" in policies.columns else policies
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    s = markets.join(F.broadcast(p), "exchange")  # policies are a short configured list
    step = F.col("interval_seconds").cast("long") * 1_000_000
    first = F.ceil(micros(lo) / step).cast("long")
    last = F.ceil(micros(hi) / step).cast("long") - 1
    s = s.where(first <= last).withColumn("slot", F.explode(F.sequence(first, last))).withColumn("slot_time", F.timestamp_micros(F.col("slot") * step)).drop("slot")
    return s.withColumn("slot_key", joined_key("exchange", "symbol_id", "data_type", "period", F.unix_seconds("slot_time")))


def missing_slots(slots: DataFrame, facts: DataFrame, ts_col: str) -> DataFrame:
    """Slots in which no fact of the symbol and venue fell."""
    sizes = slots.select("exchange", "interval_seconds").distinct()
    seen = facts.join(sizes, "exchange").select("symbol_id", "exchange", "interval_seconds", F.timestamp_micros(F.floor(micros(ts_col) / (F.col("interval_seconds").cast("long") * 1_000_000)).cast("long") * F.col("interval_seconds").cast("long") * 1_000_000).alias("slot_time")).distinct()
    return slots.join(seen, ["symbol_id", "exchange", "interval_seconds", "slot_time"], "left_anti")


def missing_runs(policies: DataFrame, markets: DataFrame, facts: DataFrame, start, end, ts_col: str = "snapshot_time") -> DataFrame:
    """What ``missing_slots`` finds, as runs: for each policy and market the first and the last slot (numbers of
    intervals) of each longest run of slots in which no fact fell. No slot is made that is not missing, so the work
    follows the facts."""
    p = policies.where("enabled") if "enabled" in policies.columns else policies
    lo, hi = micros(F.lit(start).cast("timestamp")), micros(F.lit(end).cast("timestamp"))
    s = markets.join(F.broadcast(p), "exchange")  # policies are a short configured list
    step = F.col("interval_seconds").cast("long") * 1_000_000
    s = s.withColumn("_first", F.ceil(lo / step).cast("long")).withColumn("_last", F.ceil(hi / step).cast("long") - 1).where("_first <= _last")
    keys = ["symbol_id", "exchange", "interval_seconds"]
    sizes = F.broadcast(p.select("exchange", "interval_seconds").distinct())
    seen = facts.where((micros(ts_col) >= lo - DAY) & (micros(ts_col) < hi + DAY)).join(sizes, "exchange").select(*keys, F.floor(micros(ts_col) / step).cast("long").alias("_slot")).distinct()
    ranges = s.select(*keys, "_first", "_last").distinct()
    # the slot before the range and the one after it count as seen
    inside = seen.join(ranges, keys).where("_slot between _first and _last").select(*keys, "_slot")
    ends = ranges.select(*keys, F.explode(F.array(F.col("_first") - 1, F.col("_last") + 1)).alias("_slot"))
    runs = _before(inside.unionByName(ends), keys, "_slot", 1024, "_before").where("_slot - _before > 1")
    runs = runs.select(*keys, (F.col("_before") + 1).alias("first_slot"), (F.col("_slot") - 1).alias("last_slot"))
    return s.drop("_first", "_last").join(runs, keys)


def run_slots(runs: DataFrame) -> DataFrame:
    """The slots of missing runs, one row each, with their time and key."""
    step = F.col("interval_seconds").cast("long") * 1_000_000
    s = runs.withColumn("slot_time", F.explode(F.transform(F.sequence("first_slot", "last_slot"), lambda slot: F.timestamp_micros(slot * step)))).drop("first_slot", "last_slot")
    return s.withColumn("slot_key", joined_key("exchange", "symbol_id", "data_type", "period", F.unix_seconds("slot_time")))


def backfill_slots(gaps: DataFrame, max_slots: int = 500, lag_seconds: int = 0, pause_above: int | None = None) -> DataFrame:
    """Low-priority slots, one an interval in ``[gap_start, gap_end)`` of each gap, at most ``max_slots`` a gap, the
    first ones; none while the source lags by more than the pause bound."""
    if pause_above is not None and lag_seconds > pause_above:
        gaps = gaps.where(F.lit(False))
    step = F.col("expected_interval_seconds").cast("long")
    lo = F.floor(F.unix_seconds("gap_start") / step).cast("long")
    hi = F.ceil(F.unix_seconds("gap_end") / step).cast("long") - 1
    g = gaps.where(lo <= hi).withColumn("slot", F.explode(F.sequence(lo, F.least(hi, lo + max_slots - 1))))
    g = g.withColumn("slot_time", F.timestamp_seconds(F.col("slot") * step))
    return g.select("symbol_id", "exchange", "source_symbol", "data_type", "period", "gap_key", "slot_time", F.lit("low").alias("priority"), joined_key(F.lit("backfill"), "exchange", "symbol_id", "data_type", "period", F.unix_seconds("slot_time")).alias("slot_key"))


def bucketed(df: DataFrame, ts_col: str, seconds: int) -> DataFrame:
    return df.withColumn("bucket", time_bucket(ts_col, seconds))

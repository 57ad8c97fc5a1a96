"""Cross-venue aggregates as of instants."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import deep_degraded, effective_price, mean, not_negative, positive, shallow_healthy, simple_spread, spread_bps, spread_percent, taker_delta, total
from marketlens.operators import trailing
from marketlens.operators.asof import asof_latest
from marketlens.operators.trailing import window_stats
from marketlens.options import AnalyticsOptions, FlagThresholds


def venue_metrics(ticks: DataFrame, grid: DataFrame, options: AnalyticsOptions) -> DataFrame:
    """The newest tick of each venue as of each instant, with degraded marked: health is judged after the newest row is
    chosen, so a venue whose newest row is bad does not fall back to an older one."""
    latest = asof_latest(ticks, grid, "snapshot_time", options.max_age, ties=("source_symbol",))
    return latest.withColumn("degraded", deep_degraded("raw_data")).withColumn("price", effective_price())


def aggregate_snapshot(ticks: DataFrame, grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """One row per (symbol, as_of) that has a healthy venue."""
    v = venue_metrics(ticks, grid, options)
    ok, s = ~F.col("degraded"), options.sum_scale
    v = v.withColumn("usable", F.when(ok, positive("price"))).withColumns({c: F.when(ok, not_negative(c)) for c in ("volume_24h", "quote_volume_24h", "open_interest")} | {f"_{c}": F.col(c) for c in ("volume_24h", "quote_volume_24h", "open_interest")})
    v = v.withColumn("funding_rate", F.when(ok, F.col("funding_rate")))
    quote = F.when(F.col("usable").isNotNull(), positive("quote_volume_24h"))
    bad = lambda name, raw: F.when(ok & F.col(raw).isNotNull() & ~(F.col(raw) >= 0), F.concat_ws(":", "exchange", F.lit(name)))
    bad_price = F.when(ok & (F.col("price") <= 0), F.concat_ws(":", "exchange", F.lit("price")))
    out = v.groupBy("symbol_id", "as_of").agg(
        F.count_if(ok).alias("exchange_count"),
        mean("usable", s).alias("price_avg"),
        F.try_divide(total(F.col("usable") * quote, s), total(quote, s)).alias("price_weighted"),
        F.coalesce(total("volume_24h", s), F.lit(0.0)).alias("total_volume_24h"),
        F.coalesce(total("quote_volume_24h", s), F.lit(0.0)).alias("total_quote_volume_24h"),
        F.coalesce(total("open_interest", s), F.lit(0.0)).alias("total_open_interest"),
        total(F.col("open_interest") * F.col("usable"), s).alias("total_open_interest_value"),
        mean("funding_rate", s).alias("avg_funding_rate"),
        F.min("funding_rate").alias("min_funding_rate"),
        F.max("funding_rate").alias("max_funding_rate"),
        F.sort_array(F.collect_list(F.when(ok, F.col("exchange")))).alias("available_exchanges"),
        F.sort_array(F.collect_list(F.when(~ok, F.col("exchange")))).alias("skipped_exchanges"),
        F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array(bad_price, *[bad(n, f"_{n}") for n in ("volume_24h", "quote_volume_24h", "open_interest")]))))).alias("invalid_fields"),
    )
    return out.where("exchange_count > 0")


def raw_by_exchange(ticks: DataFrame, grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """Venue to raw payload of the healthy venues, as a map in the order of their names."""
    v = venue_metrics(ticks, grid, options).where("not degraded")
    pairs = F.array_sort(F.collect_list(F.struct("exchange", F.coalesce("raw_data", F.lit("{}")))))
    return v.groupBy("symbol_id", "as_of").agg(F.map_from_entries(pairs).alias("raw_by_exchange"))


def enrichment(tables: Mapping[str, DataFrame], grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """Sums over each venue's newest taker flow, CVD, basis and book as of the instant, whatever its health, and the
    liquidation buckets of the last minutes. Tables that are not given leave their columns null."""
    s = options.sum_scale
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = grid.select("symbol_id", "as_of").distinct()

    def add(name, ties, aggs, fill):
        nonlocal out
        if name in tables:
            got = asof_latest(tables[name], grid, "snapshot_time", options.max_age, ties=ties).groupBy("symbol_id", "as_of").agg(*aggs)
            out = out.join(got, ["symbol_id", "as_of"], "left").fillna(0.0, fill)

    part = lambda c: total(F.when(F.col(c) >= 0, F.col(c)).otherwise(0.0), s)
    add("taker_flow", ("period",), [part("taker_buy_volume").alias("total_taker_buy_volume"), part("taker_sell_volume").alias("total_taker_sell_volume"), zero(total("buy_sell_delta", s)).alias("total_buy_sell_delta")], ["total_taker_buy_volume", "total_taker_sell_volume", "total_buy_sell_delta"])
    add("cvd", ("period",), [zero(total("cvd_value", s)).alias("total_cvd")], ["total_cvd"])
    add("basis", (), [mean("basis_percent", s).alias("avg_basis_percent")], [])
    add("orderbook", ("depth_levels",), [mean("imbalance_percent", s).alias("avg_imbalance_percent"), part("bid_depth_usd").alias("total_bid_depth_usd"), part("ask_depth_usd").alias("total_ask_depth_usd")], ["total_bid_depth_usd", "total_ask_depth_usd"])
    if "liquidations" in tables:
        names = ("long", "short", "total")
        kept = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(0.0).cast("double" if s is None else f"decimal(28,{s})")
        got = window_stats(tables["liquidations"], grid, "bucket_time", {"w": options.liquidation_lookback}, {f"{n}_usd": trailing.total(F.when(F.col(f"{n}_liquidation_usd").isNotNull(), kept(f"{n}_liquidation_usd"))) for n in names}, closed=True)
        out = out.join(got.select("symbol_id", "as_of", *[zero(F.col(f"{n}_usd").cast("double")).alias(f"{n}_liquidation_usd") for n in names]), ["symbol_id", "as_of"], "left").fillna(0.0, [f"{n}_liquidation_usd" for n in names])
    return out


def point_aggregate(ticks: DataFrame, grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """Average price, summed volume and open interest and number of venues at any instants."""
    v, s = venue_metrics(ticks, grid, options).where("not degraded"), options.sum_scale
    return v.groupBy("symbol_id", "as_of").agg(mean(positive("price"), s).alias("price"), total(not_negative("volume_24h"), s).alias("volume"), total(not_negative("open_interest"), s).alias("open_interest"), F.count(F.lit(1)).alias("exchange_count"))


def cvd_at(cvd: DataFrame, grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """Sum over venues of the newest healthy cumulative delta: health is judged before the newest row is chosen."""
    healthy = cvd.where(shallow_healthy("raw_data"))
    return asof_latest(healthy, grid, "snapshot_time", options.max_age, ties=("period",)).groupBy("symbol_id", "as_of").agg(total("cvd_value", options.sum_scale).alias("cvd"))


def window_metrics(tables: Mapping[str, DataFrame], grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """One row per (symbol, as_of, window): changes between the two ends, and statistics over ``(as_of - w, as_of]``.

    tables: ticks, and any of funding, taker_flow, cvd, liquidations and basis; what is not given stays null.
    """
    s, windows = options.sum_scale, options.windows
    grid = grid.select("symbol_id", F.col("as_of").cast("timestamp").alias("as_of")).distinct()
    ends = grid.select("symbol_id", "as_of", F.explode(F.array(*[F.struct(F.lit(label).alias("window"), F.lit(w).alias("w")) for label, w in windows.items()])).alias("x")).select("symbol_id", "as_of", "x.*")
    ends = ends.withColumn("start_time", F.timestamp_micros(F.unix_micros("as_of") - F.col("w"))).drop("w")
    instants = grid.unionByName(ends.select("symbol_id", F.col("start_time").alias("as_of"))).distinct()

    def at(points: DataFrame, values: list[str]) -> DataFrame:
        now = points.select("symbol_id", "as_of", *[F.col(c).alias(f"{c}_now") for c in values])
        then = points.select("symbol_id", F.col("as_of").alias("start_time"), *[F.col(c).alias(f"{c}_then") for c in values])
        return ends.join(now, ["symbol_id", "as_of"], "left").join(then, ["symbol_id", "start_time"], "left")

    values = ["price", "volume", "open_interest", "exchange_count"]
    out = at(point_aggregate(tables["ticks"], instants, options), values)
    change = lambda c: F.col(f"{c}_now") - F.col(f"{c}_then")
    out = out.select("symbol_id", "as_of", "window", "start_time", change("price").alias("price_change"), (F.try_divide(change("price"), F.col("price_then")) * 100).alias("price_change_pct"), change("volume").alias("volume_change"), change("open_interest").alias("oi_change"), *[F.coalesce(f"exchange_count_{x}", F.lit(0)).alias(f"exchange_count_{x}") for x in ("now", "then")])
    on = ["symbol_id", "as_of", "window"]
    if "cvd" in tables:
        c = at(cvd_at(tables["cvd"], instants, options), ["cvd"])
        out = out.join(c.select(*on, (F.coalesce("cvd_now", F.lit(0.0)) - F.coalesce("cvd_then", F.lit(0.0))).alias("cvd_change")), on, "left")
    exact = lambda c: F.col(c) if s is None else F.col(c).cast(f"decimal(28,{s})")
    specs = {
        "funding": ("snapshot_time", F.col("funding_rate")),
        "basis": ("snapshot_time", F.col("basis_percent")),
        "taker_delta": ("snapshot_time", taker_delta()),
        "liquidation_sum_usd": ("bucket_time", F.when(F.col("total_liquidation_usd") >= 0, F.col("total_liquidation_usd")).otherwise(0.0)),
    }
    source = {"taker_delta": "taker_flow", "liquidation_sum_usd": "liquidations"}
    given = {k: (tables[source.get(k, k)], ts, v) for k, (ts, v) in specs.items() if source.get(k, k) in tables}
    if not given:
        return out
    # all facts as one stream with a column each, so that the windows are covered once
    facts, stats, cols = None, {}, []
    for k, (table, ts, value) in given.items():
        own = table.where(shallow_healthy("raw_data")).select("symbol_id", F.col(ts).alias("_ts"), value.alias(k))
        facts = own if facts is None else facts.unionByName(own, allowMissingColumns=True)
        stats[f"{k}_s"] = trailing.total(exact(k))
        if k in source:
            cols.append(F.coalesce(F.col(f"{k}_s").cast("double"), F.lit(0.0)).alias(k))
        else:
            stats |= {f"{k}_n": trailing.count(F.col(k)), f"{k}_min": trailing.lowest(F.col(k)), f"{k}_max": trailing.highest(F.col(k))}
            cols += [(F.col(f"{k}_s").cast("double") / F.nullif(F.col(f"{k}_n"), F.lit(0))).alias(f"{k}_avg"), f"{k}_min", f"{k}_max"]
    out = out.join(window_stats(facts, grid, "_ts", windows, stats).select(*on, *cols), on, "left")
    return out


def exchange_divergence(ticks: DataFrame, grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """Spread of price, open interest, funding and volume over at least two healthy venues; the weakest and strongest
    venue have the lowest and highest price, the first by name among equals."""
    v = venue_metrics(ticks, grid, options).where("not degraded")
    v = v.select("symbol_id", "as_of", "exchange", positive("price").alias("price"), not_negative("open_interest").alias("oi"), F.col("funding_rate").alias("funding"), not_negative("volume_24h").alias("volume"))
    names = ("price", "oi", "funding", "volume")
    lowest = F.min(F.when(F.col("price").isNotNull(), F.struct("price", "exchange")))["exchange"]
    highest = F.min(F.when(F.col("price").isNotNull(), F.struct((-F.col("price")).alias("p"), "exchange")))["exchange"]
    g = v.groupBy("symbol_id", "as_of").agg(F.count(F.lit(1)).alias("exchange_count"), *[f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))], lowest.alias("weakest_exchange"), highest.alias("strongest_exchange"))
    g = g.where("exchange_count >= 2")
    return g.select("*", spread_percent("price_min", "price_max").alias("price_spread_percent"), spread_percent("oi_min", "oi_max").alias("oi_spread_percent"), simple_spread("funding_min", "funding_max").alias("funding_spread"), spread_percent("volume_min", "volume_max").alias("volume_spread_percent"), simple_spread("price_min", "price_max").alias("divergence_abs"), spread_bps("price_min", "price_max").alias("divergence_bps"))


def anomaly_flags(metrics: DataFrame, snapshot: DataFrame | None = None, thresholds: FlagThresholds = FlagThresholds()) -> DataFrame:
    """One row per flag: symbol_id, as_of, window (null for whole-snapshot flags), name, severity, value."""
    c, t = F.col, thresholds

    def flag(name: str, condition, value):
        return F.when(condition, F.struct(F.lit(name).alias("name"), F.lit("info").alias("severity"), value.alias("value")))

    flags = F.array_compact(
        F.array(
            flag("large_liquidation_cluster", c("liquidation_sum_usd") >= t.liquidation_usd, c("liquidation_sum_usd")),
            flag("elevated_basis", F.abs("basis_avg") >= t.basis_percent, c("basis_avg")),
            flag("positive_funding_extreme", c("funding_max") >= t.funding_rate, c("funding_max")),
            flag("negative_funding_extreme", c("funding_min") <= -t.funding_rate, c("funding_min")),
        )
    )
    for name in ("liquidation_sum_usd", "basis_avg", "funding_max", "funding_min"):
        if name not in metrics.columns:
            metrics = metrics.withColumn(name, F.lit(None).cast("double"))
    out = metrics.select("symbol_id", "as_of", "window", F.explode(flags).alias("f")).select("symbol_id", "as_of", "window", "f.*")
    if snapshot is not None:
        book = snapshot.where(F.abs("avg_imbalance_percent") >= t.imbalance_percent)
        out = out.unionByName(book.select("symbol_id", "as_of", F.lit(None).cast("string").alias("window"), F.lit("orderbook_imbalance").alias("name"), F.lit("info").alias("severity"), F.col("avg_imbalance_percent").alias("value")))
    return out


#: Window measures by their names in the record's JSON.
_MEASURES = {"price_change": "price_change", "price_change_percent": "price_change_pct", "volume_change": "volume_change", "oi_change": "oi_change", **{c: c for c in ("funding_avg", "funding_min", "funding_max", "taker_delta", "cvd_change", "liquidation_sum_usd", "basis_avg", "basis_min", "basis_max")}}


def _utc(x) -> Column:
    """Text of a time: UTC, microseconds without trailing zeros."""
    digits = F.rtrim(F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))
    return F.concat(F.rtrim(digits, F.lit(".")), F.lit("Z"))


def window_json(metrics: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """symbol_id, as_of, window_metrics (an array of the windows, shortest first) and metrics (the same as an object);
    measures that are null are left out."""
    names = list(options.windows)
    quality = F.struct(F.col("exchange_count_now").alias("current_exchange_count"), F.col("exchange_count_then").alias("previous_exchange_count"), F.lit(options.max_age // 1_000_000).alias("max_snapshot_age_seconds"))
    known = [F.col(c).alias(name) for name, c in _MEASURES.items() if c in metrics.columns]
    one = F.struct(F.col("window"), _utc("start_time").alias("start_time"), _utc("as_of").alias("end_time"), *known, quality.alias("quality"))
    # as many rows an instant as there are windows
    all_windows = F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("window")).alias("at"), one.alias("w")))), lambda x: x["w"])
    rows = metrics.groupBy("symbol_id", "as_of").agg(all_windows.alias("w"))
    return rows.select("symbol_id", "as_of", F.to_json("w").alias("window_metrics"), F.to_json(F.struct(F.col("w").alias("windows"))).alias("metrics"))


def flags_json(flags: DataFrame, options: AnalyticsOptions = AnalyticsOptions()) -> DataFrame:
    """symbol_id, as_of and anomaly_flags: an array by window, shortest first and the snapshot's own last, in the order in
    which the rules are listed."""
    order = ("large_liquidation_cluster", "elevated_basis", "positive_funding_extreme", "negative_funding_extreme", "orderbook_imbalance")
    at = F.when(F.col("window").isNull(), len(options.windows) + 1).otherwise(F.array_position(F.array(*map(F.lit, options.windows)), F.col("window")))
    rule = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    listed = F.array_sort(F.collect_list(F.struct(at.alias("at"), rule.alias("rule"), F.struct("name", "window", "severity", "value").alias("f"))))
    return flags.groupBy("symbol_id", "as_of").agg(F.to_json(F.transform(listed, lambda x: x["f"])).alias("anomaly_flags"))


def quality_json(as_of, included, skipped, invalid, options: AnalyticsOptions) -> Column:
    """What went into a snapshot: the venues taken, those left out with the reason, and the measures left out by venue.
    included and skipped: arrays of venues; invalid: an array of ``venue:measure``. Empty maps are left out."""
    reason = F.map_from_entries(F.transform(skipped, lambda v: F.struct(v, F.array(F.lit("degraded_raw_data")))))
    venue = lambda x: F.regexp_extract(x, "^(.*):", 1)
    measure = lambda x: F.substring_index(x, ":", -1)
    order = F.array(*map(F.lit, ("price", "volume_24h", "quote_volume_24h", "open_interest")))
    of = lambda v: F.filter(order, lambda m: F.exists(invalid, lambda x: (venue(x) == v) & (measure(x) == m)))
    fields = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(invalid, venue))), lambda v: F.struct(v, of(v))))
    age = options.max_age
    cutoff = F.timestamp_micros(F.unix_micros(as_of) - age)
    return F.to_json(F.struct(F.lit(age // 1_000_000).alias("max_snapshot_age_seconds"), _utc(as_of).alias("snapshot_time"), _utc(cutoff).alias("stale_cutoff"), F.array_sort(included).alias("included_exchanges"), F.when(F.size(skipped) > 0, reason).alias("skipped_exchanges"), F.when(F.size(invalid) > 0, fields).alias("invalid_fields")))


def aggregate_records(tables: Mapping[str, DataFrame], grid: DataFrame, options: AnalyticsOptions = AnalyticsOptions(), thresholds: FlagThresholds = FlagThresholds()) -> DataFrame:
    """The whole aggregate of each symbol and instant with a healthy venue, as a table keeps it: the snapshot, what other
    facts add to it, and JSON of venues, payloads, windows, quality and flags. tables: ticks, and any of those that
    ``enrichment`` and ``window_metrics`` know."""
    on = ["symbol_id", "as_of"]
    snapshot = aggregate_snapshot(tables["ticks"], grid, options)
    more = enrichment(tables, grid, options)
    metrics = window_metrics(tables, grid, options)
    book = more if "orderbook" in tables else None
    flags = flags_json(anomaly_flags(metrics, book, thresholds), options)
    out = snapshot.join(raw_by_exchange(tables["ticks"], grid, options), on, "left").join(more, on, "left").join(window_json(metrics, options), on, "left").join(flags, on, "left")
    quality = quality_json(F.col("as_of"), F.col("available_exchanges"), F.col("skipped_exchanges"), F.col("invalid_fields"), options)
    # payloads are JSON already and stay as they are; a venue's name becomes a JSON text
    key = lambda venue: F.regexp_replace(F.to_json(F.array(venue)), r"^\[|\]$", "")
    raw = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("raw_by_exchange"), lambda e: F.concat(key(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    out = out.withColumns({"quality_metadata": quality, "available_exchanges": F.to_json(F.array_sort("available_exchanges")), "raw_by_exchange": F.coalesce(raw, F.lit("{}")), "anomaly_flags": F.coalesce("anomaly_flags", F.lit("null"))})
    return out.withColumnRenamed("as_of", "snapshot_time").drop("skipped_exchanges", "invalid_fields")

"""Validation: each row is valid or becomes a quality issue with the first rule it fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import event_key, micros
from marketlens.options import ValidationOptions

# Fixed value: a period is a number with a unit, or a venue's word for it.
PERIOD = r"^([0-9]+[smhdwM]|Min[0-9]+|Hour[0-9]+|Day[0-9]+|Week[0-9]+|Month[0-9]+)$"

#: Fixed value: white space that a text is trimmed of before it is looked at.
SPACE = " \t\n\x0b\x0c\r\x85\xa0"

#: (issue type, message, condition of failure, columns that it needs); a null condition passes.
Rule = tuple[str, str, Column, tuple[str, ...]]


def _trimmed(c: str | Column) -> Column:
    """Text without white space around it; null is empty."""
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(SPACE))


def _blank(c: str) -> Column:
    return _trimmed(c) == ""


def _negative(*columns: str) -> list[Rule]:
    return [("invalid_value", f"{c} must not be negative", F.col(c) < 0, (c,)) for c in columns]


def _time(c: str) -> Rule:
    return ("invalid_timestamp", f"{c} is required", F.col(c).isNull(), (c,))


def _period(c: str, required: bool = False) -> list[Rule]:
    """A period that is given must be well formed; only some records must have one."""
    bad = ("invalid_period", f"malformed period in {c}", ~_blank(c) & ~_trimmed(c).rlike(PERIOD), (c,))
    return [("invalid_period", f"{c} is required", _blank(c), (c,)), bad] if required else [bad]


def _rate(c: str, limit: float, kind: str = "invalid_value") -> Rule:
    return (kind, f"{c} is out of range", F.abs(c) > limit, (c,))


def _required(c: str, kind: str = "invalid_value") -> Rule:
    return (kind, f"{c} is required", _blank(c), (c,))


#: Measures that must not be negative, by record type, in the order in which they are looked at.
MEASURES: dict[str, tuple[str, ...]] = {
    "market_snapshot": ("last_price", "mark_price", "index_price", "bid_price", "ask_price", "volume_24h", "quote_volume_24h", "open_interest"),
    "kline": ("open_price", "high_price", "low_price", "close_price", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume"),
    "open_interest": ("open_interest", "open_interest_value"),
    "open_interest_history": ("open_interest", "open_interest_value"),
    "funding": ("mark_price", "index_price"),
    "funding_history": ("mark_price",),
    "taker_flow": ("taker_buy_volume", "taker_sell_volume", "taker_buy_quote_volume", "taker_sell_quote_volume"),
    "liquidation_event": ("price", "quantity", "notional", "usd_value"),
    "liquidation_aggregate": (*[f"{side}_liquidation_{unit}" for unit in ("notional", "usd") for side in ("long", "short", "total")], "largest_liquidation_usd"),
    "basis": ("futures_price", "mark_price", "index_price", "spot_price"),
    "orderbook": ("mid_price", "bid_notional", "ask_notional", "bid_depth_usd", "ask_depth_usd", *[f"{side}_depth_{p}pct_usd" for p in (1, 2, 5) for side in ("bid", "ask")]),
}

#: Record type: its time column, and its own rules before those of its measures.
RECORDS: dict[str, tuple[str, Callable[[], list[Rule]]]] = {
    "market_snapshot": ("snapshot_time", list),
    "kline": ("open_time", lambda: [*_period("interval"), _time("open_time"), _time("close_time")]),
    "open_interest": ("snapshot_time", list),
    "open_interest_history": ("snapshot_time", lambda: _period("period", required=True)),
    "funding": ("snapshot_time", lambda: [_rate("funding_rate", 1.0)]),
    "funding_history": ("funding_time", lambda: [_rate("funding_rate", 1.0)]),
    "long_short_ratio": ("snapshot_time", lambda: _period("period")),
    "taker_flow": ("snapshot_time", lambda: _period("period")),
    "cvd": ("snapshot_time", lambda: _period("period")),
    "liquidation_event": ("event_time", lambda: [_required("event_key", "missing_key"), _required("side")]),
    "liquidation_aggregate": ("bucket_time", lambda: _period("period")),
    "basis": ("snapshot_time", list),
    "orderbook": ("snapshot_time", lambda: [("invalid_value", "depth_levels must be positive", ~F.coalesce(F.col("depth_levels") > 0, F.lit(False)), ("depth_levels",))]),
    "divergence": ("snapshot_time", lambda: [_required("data_type")]),
}
#: Record types of which a period can be asked, and its column.
ASKED_PERIOD = {"kline": "interval", "taker_flow": "period", "cvd": "period", "long_short_ratio": "period", "liquidation_aggregate": "period"}
#: Record types whose funding rate must be plausible.
FUNDED = ("market_snapshot", "funding", "funding_history")


def rules(record: str, columns: list[str], now: Column, options: ValidationOptions, requested_period: str | None = None) -> list[Rule]:
    """All rules of a record type in the order in which they are tried; rules over absent columns do not apply.

    ``requested_symbol``, a column, and ``requested_period`` are what was asked for; blank means anything. Both are
    compared without the white space around them, and in their case.
    """
    time, own = RECORDS[record]
    asked = _trimmed("requested_symbol")
    out: list[Rule] = [
        ("invalid_source", "symbol_id must be positive", ~F.coalesce(F.col("symbol_id") > 0, F.lit(False)), ()),
        ("invalid_source", "exchange is required", _blank("exchange"), ()),
        ("invalid_source", "source_symbol is required", _blank("source_symbol"), ()),
        ("symbol_mismatch", "source_symbol is not the requested one", (asked != "") & (_trimmed("source_symbol") != asked), ("requested_symbol",)),
        _time(time),
        ("future_timestamp", f"{time} lies in the future", micros(time) > micros(now) + options.future_skew, (time,)),
    ]
    if record in FUNDED:
        out.append(("funding_outlier", "funding_rate is implausible", F.abs("funding_rate") > options.funding_limit, ("funding_rate",)))
    if (wanted := (requested_period or "").strip(SPACE)) and (c := ASKED_PERIOD.get(record)):
        out.append(("interval_mismatch", f"{c} is not the requested one", _trimmed(c) != wanted, (c,)))
    if record == "market_snapshot":
        out += [*_negative(*MEASURES[record]), _rate("funding_rate", 1.0)]
    else:
        out += [*own(), *_negative(*MEASURES.get(record, ()))]
    have = set(columns)
    return [rule for rule in out if have.issuperset(rule[3])]


def quarantine(df: DataFrame, record: str, now, options: ValidationOptions = ValidationOptions(), requested_period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, issues). The two partition the input; an issue names the first rule that failed."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    if record == "liquidation_event":
        key = F.when(_blank("event_key"), event_key()).otherwise(F.col("event_key")) if "event_key" in df.columns else event_key()
        df = df.withColumn("event_key", key)
    verdict = None
    for kind, message, failed, _ in rules(record, df.columns, now, options, requested_period):
        hit = F.struct(F.lit(kind).alias("issue_type"), F.lit(message).alias("error"))
        verdict = F.when(failed, hit) if verdict is None else verdict.when(failed, hit)
    judged = df.withColumn("_issue", verdict)
    time = RECORDS[record][0]
    issues = judged.where("_issue is not null").select("symbol_id", "exchange", "source_symbol", F.lit(record).alias("data_type"), F.col(time).alias("observed_at"), "_issue.*")
    issues = issues.withColumn("severity", F.lit("warning")).withColumn("issue_key", F.sha1(F.concat_ws("|", F.lit(record), F.coalesce(F.col("symbol_id").cast("string"), F.lit("")), F.coalesce("exchange", F.lit("")), F.coalesce("source_symbol", F.lit("")), "issue_type", "error")))
    return judged.where("_issue is null").drop("_issue"), issues

"""Derived columns and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD_STATUSES = ("degraded", "failed", "invalid", "unhealthy")

#: A status-like key with a bad status at any depth, or a boolean key that says so.
_DEEP = r'(?i)("\s*(quality_status|data_quality|normalized_status|status|health)\s*"\s*:\s*"\s*(degraded|failed|invalid|unhealthy)\s*")|("\s*(degraded|failed)\s*"\s*:\s*true\b)'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- numbers and times of payloads ----


def number(x) -> Column:
    """Text, or anything shown as text, to a double; blank or malformed is null."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def text(x) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(_c(x).cast("string")), F.lit(""))


def from_epoch_ms(x) -> Column:
    ms = number(x).cast("long")
    return F.when(ms > 0, F.timestamp_millis(ms))


def from_epoch_s(x) -> Column:
    s = number(x).cast("long")
    return F.when(s > 0, F.timestamp_seconds(s))


def micros(x) -> Column:
    return F.unix_micros(_c(x).cast("timestamp"))


def time_bucket(x, seconds: int) -> Column:
    """Start of the bucket of so many seconds since the epoch."""
    return F.timestamp_seconds(F.floor(micros(x) / (seconds * 1_000_000)) * seconds)


def total(x, scale: int | None = None) -> Column:
    """Sum; with a scale, of exact decimals, so that the order of the rows cannot show."""
    return F.sum(_c(x)) if scale is None else F.sum(_c(x).cast(f"decimal(28,{scale})")).cast("double")


def mean(x, scale: int | None = None) -> Column:
    return total(x, scale) / F.nullif(F.count(_c(x)), F.lit(0))


# ---- health of a row ----


def shallow_healthy(raw) -> Column:
    """The first of three top-level status fields, if any, is not a bad one."""
    raw = _c(raw)
    status = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("quality_status", "status", "normalized_status")], F.lit("ok"))
    return ~F.lower(status).isin(*BAD_STATUSES)


def deep_degraded(raw) -> Column:
    """A bad status anywhere in the JSON; text that is no JSON, and null, are healthy."""
    raw = _c(raw)
    return F.coalesce(raw.rlike(_DEEP) & F.try_parse_json(raw).isNotNull(), F.lit(False))


# ---- prices, fills and spreads ----


def effective_price(last="last_price", mark="mark_price") -> Column:
    """Last price, or mark price where there is no last."""
    return F.coalesce(_c(last), _c(mark))


def positive(x) -> Column:
    return F.when(_c(x) > 0, _c(x))


def not_negative(x) -> Column:
    return F.when(_c(x) >= 0, _c(x))


def event_usd(usd="usd_value", notional="notional", price="price", quantity="quantity") -> Column:
    return F.coalesce(_c(usd), _c(notional), _c(price) * _c(quantity), F.lit(0.0))


def taker_delta() -> Column:
    """The best available difference of taker volumes: given in quote or base, else computed in quote or base, else 0."""
    c = F.col
    return F.coalesce(c("buy_sell_delta_quote"), c("buy_sell_delta"), c("taker_buy_quote_volume") - c("taker_sell_quote_volume"), c("taker_buy_volume") - c("taker_sell_volume"), F.lit(0.0))


def spread_percent(low, high) -> Column:
    """Null when the lower value is 0."""
    return F.try_divide(_c(high) - _c(low), _c(low)) * 100


def simple_spread(low, high) -> Column:
    return _c(high) - _c(low)


def spread_bps(low, high) -> Column:
    """0 when the lower value is 0."""
    gap = _c(high) - _c(low)
    return F.when(gap.isNotNull(), F.coalesce(F.try_divide(gap, _c(low)) * 10000, F.lit(0.0)))


def display_price(weighted="price_weighted", average="price_avg") -> Column:
    return F.coalesce(_c(weighted), _c(average))


# ---- labels ----


def freshness(as_of, time, stale_s: int = 900, lagging_s: int = 300) -> Column:
    age = micros(as_of) - micros(time)
    return F.when(_c(time).isNull(), "unknown").when(age < 0, "future").when(age > stale_s * 1_000_000, "stale").when(age > lagging_s * 1_000_000, "lagging").otherwise("fresh")


def worst_health(unhealthy, degraded) -> Column:
    return F.when(_c(unhealthy) > 0, "unhealthy").when(_c(degraded) > 0, "degraded").otherwise("healthy")


def request_error(status, message) -> Column:
    """(type, recoverable, rate_limited) of a logged request: by its status code if it failed with one, else by words of
    the message; null for a request that went well."""
    status, m = _c(status), F.lower(F.coalesce(_c(message), F.lit("")))
    has = lambda *words: F.coalesce(*[F.when(m.contains(w), F.lit(True)) for w in words], F.lit(False))
    out = lambda kind, again=False, limited=False: F.struct(F.lit(kind).alias("error_type"), F.lit(again).alias("recoverable"), F.lit(limited).alias("rate_limited"))
    by_status = (
        F.when(status == 429, out("rate_limited", True, True))
        .when(status.isin(401, 403), out("unauthorized"))
        .when(status == 404, out("not_found"))
        .when((status == 400) & has("invalid symbol", "unknown symbol", "instrument_id", "symbol invalid"), out("invalid_symbol"))
        .when(status >= 500, out("server_error", True))
        .when(status >= 400, out("bad_request"))
    )
    by_message = (
        F.when(has("deadline exceeded", "context canceled", "timeout"), out("timeout", True))
        .when(has("connection re", "no such host", "network is unreachable", "broken pipe"), out("network_error", True))
        .when(has("rate limit", "too many requests"), out("rate_limited", True, True))
        .when(has("invalid symbol", "unknown symbol"), out("invalid_symbol"))
        .when(has("unauthorized", "forbidden"), out("unauthorized"))
        .when(has("not found"), out("not_found"))
        .when(has("unresolved request placeholder", "malformed template"), out("bad_request"))
        .when(has("normalize"), out("normalizer_error"))
        .when(has("parse", "invalid response"), out("invalid_response"))
        .when(m != "", out("unknown", True))
    )
    return F.when(status >= 400, by_status).otherwise(by_message)


# ---- identity strings ----


def event_key(exchange="exchange", symbol="source_symbol", side="side", price="price", quantity="quantity", time="event_time") -> Column:
    """Natural key of a liquidation: a hash of venue, symbol, side, price, quantity and time."""
    fixed = lambda x: F.coalesce(F.format_string("%.18f", _c(x)), F.lit(""))
    stamp = F.concat(F.date_format(_c(time), "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.format_string(".%06d", F.pmod(micros(time), F.lit(1_000_000))), "0+$", ""), r"\.$", ""), F.lit("Z"))
    return F.concat(F.lit("liq:"), F.sha1(F.concat_ws("|", F.lower(F.trim(_c(exchange))), F.trim(_c(symbol)), F.lower(F.trim(_c(side))), fixed(price), fixed(quantity), stamp)))


def gap_key(kind: str = "kline") -> Column:
    """Hash that identifies a gap of symbol_id, exchange, data_type, period, gap_start and gap_end."""
    stamp = lambda x: F.date_format(F.col(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.sha1(F.concat_ws("|", F.col("symbol_id").cast("string"), "exchange", "data_type", F.coalesce("period", F.lit("")), stamp("gap_start"), stamp("gap_end")))


def joined_key(*parts) -> Column:
    """Identity text: the parts, with a colon between them, null as nothing."""
    return F.concat_ws(":", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])

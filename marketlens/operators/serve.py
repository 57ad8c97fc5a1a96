"""List queries: filters, order, pages with totals, overview and symbol lookup."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import display_price, freshness, micros
from marketlens.operators.asof import latest_by_key
from marketlens.options import DAY, MINUTE, SECOND, ListOptions

#: Series: its time column, its period column, and the period taken when none is asked for.
SERIES = {
    "market": ("snapshot_time", None, None),
    "klines": ("open_time", "interval", "5m"),
    "open_interest": ("snapshot_time", None, None),
    "open_interest_history": ("timestamp", "period", None),
    "funding": ("snapshot_time", None, None),
    "long_short_ratio": ("snapshot_time", "period", "5m"),
    "taker_flow": ("snapshot_time", "period", "5m"),
    "cvd": ("snapshot_time", "period", "5m"),
    "liquidations": ("event_time", None, None),
    "basis": ("snapshot_time", None, None),
    "orderbook": ("snapshot_time", None, None),
    "divergence": ("snapshot_time", None, None),
}

#: Widths of the time buckets (microseconds) that close in on a page, and how many rows may be sorted for one.
WIDTHS = (DAY, MINUTE, SECOND, 1)
FEW = 10_000

#: Sortable columns of the overview.
SORTS = {"symbol": "symbol", "rank": "rank", "volume": "total_volume_24h", "oi": "total_open_interest", "funding": "avg_funding_rate", "price": "display_price", "freshness": "snapshot_time"}


def filtered(df: DataFrame, options: ListOptions, time: str, period: str | None, default_period: str | None) -> DataFrame:
    c = F.col
    if options.symbol_id is not None:
        df = df.where(c("symbol_id") == options.symbol_id)
    if options.start is not None:
        df = df.where(c(time) >= F.lit(options.start).cast("timestamp"))
    if options.end is not None:
        df = df.where(c(time) <= F.lit(options.end).cast("timestamp"))
    if options.exchange:
        df = df.where(c("exchange") == options.exchange.strip().lower())
    wanted = options.period or default_period
    if period and wanted:
        df = df.where(c(period) == wanted)
    return df


def page(df: DataFrame, order: list, options: ListOptions) -> DataFrame:
    """The page's rows with total_count. The total is a count of its own, not a window over one partition; a page past
    the end is empty."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    rows = df.orderBy(*order).offset(options.offset).limit(options.limit)
    return rows.join(F.broadcast(total), F.lit(True))  # one row


@dataclass(frozen=True)
class Place:
    """Where a page by time lies: bounds of its times (microseconds, the upper one left out; None if it has no row with a
    time), whether rows without a time are among them, rows of that part before the page, and rows of the whole list."""

    low: int | None
    high: int | None
    untimed: bool
    skip: int
    total: int

    def holds(self, df: DataFrame, time: str) -> Column:
        c = F.col(time)
        at = lambda us: F.timestamp_micros(F.lit(us)).cast(df.schema[time].dataType)
        timed = F.lit(False) if self.low is None else (c >= at(self.low)) & (c < at(self.high))
        return timed | c.isNull() if self.untimed else timed


def find_page(df: DataFrame, time: str, descending: bool, offset: int, limit: int, few: int = FEW) -> Place:
    """Close in on the rows ``offset`` to ``offset + limit`` by time: rows are counted by day, and what lies in the days of
    the page by minute, second and microsecond, until few rows are left besides the page's own. A level reads only the
    time column between the bounds of the level before, and its counts are at most the days of the table, or the page's
    rows and two buckets' parts. Rows without a time come first, or last where newest comes first."""
    place, total = Place(None, None, False, offset, 0), None
    for width in WIDTHS:
        part = df if total is None else df.where(place.holds(df, time))
        counts = part.groupBy(F.floor(micros(time) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        order = F.col("b").desc_nulls_last() if descending else F.col("b").asc_nulls_first()
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        hit = (F.col("before") < place.skip + limit) & (F.col("before") + F.col("n") > place.skip)
        of = lambda c: F.when(hit, F.col(c))  # noqa: E731, B023
        found = placed.agg(F.sum("n").alias("all"), F.sum(of("n")).alias("rows"), F.min(of("b")).alias("low"), F.max(of("b")).alias("high"), F.min(of("before")).alias("before"), F.count_if(hit & F.col("b").isNull()).alias("untimed")).first()
        total = (found["all"] or 0) if total is None else total
        if found["rows"] is None:  # past the end
            return Place(None, None, False, 0, total)
        timed = found["low"] is not None
        place = Place(found["low"] * width if timed else None, (found["high"] + 1) * width if timed else None, found["untimed"] > 0, place.skip - found["before"], total)
        if not timed or found["rows"] <= few + limit:
            break
    return place


def page_by_time(df: DataFrame, time: str, ties: list, options: ListOptions, few: int = FEW) -> DataFrame:
    """The page's rows by time, then ties, with total_count, however deep it lies: only the rows of its buckets are read
    in whole and sorted."""
    place = find_page(df, time, options.descending, options.offset, options.limit, few)
    by = F.col(time).desc_nulls_last() if options.descending else F.col(time).asc_nulls_first()
    rows = df.where(place.holds(df, time)).orderBy(by, *ties).offset(place.skip).limit(options.limit)
    return rows.withColumn("total_count", F.lit(place.total).cast("long"))


def _series(df: DataFrame, series: str, options: ListOptions) -> tuple[DataFrame, str, list[str]]:
    time, period, default = SERIES[series]
    return filtered(df, options, time, period, default), time, [c for c in ("symbol_id", "exchange", period, "event_key") if c and c in df.columns]


def list_series(df: DataFrame, series: str, options: ListOptions = ListOptions()) -> DataFrame:
    """A page of a series by time, ties by venue."""
    rows, time, ties = _series(df, series, options)
    return page_by_time(rows, time, ties, options)


def newest_rows(df: DataFrame, series: str, options: ListOptions = ListOptions()) -> DataFrame:
    """The first page of a series, newest first, without its total: each task keeps a page's rows."""
    rows, time, ties = _series(df, series, options)
    return rows.orderBy(F.col(time).desc(), *ties).limit(options.limit)


def overview(symbols: DataFrame, snapshots: DataFrame, as_of=None) -> DataFrame:
    """Active symbols with their newest aggregate, if any."""
    newest = latest_by_key(snapshots, ["symbol_id"], "snapshot_time")
    out = symbols.where("is_active").join(newest, "symbol_id", "left").withColumn("display_price", display_price())
    return out if as_of is None else out.withColumn("freshness", freshness(F.lit(as_of).cast("timestamp"), "snapshot_time"))


def overview_filter(df: DataFrame, search: str | None = None, category: str | None = None, exchange: str | None = None, min_volume: float | None = None, min_open_interest: float | None = None, rank_from: int | None = None, rank_to: int | None = None) -> DataFrame:
    """markets is an array of structs; a venue or market type must be among them."""
    c = F.col
    if search:
        like = f"%{search}%"
        df = df.where(c("symbol").ilike(like) | c("base_asset").ilike(like) | c("quote_asset").ilike(like))
    if category:
        df = df.where(c("category") == category) if "category" in df.columns else df.where(F.exists("markets", lambda m: F.lower(m["market_type"]) == category.lower()))
    if exchange:
        df = df.where(F.exists("markets", lambda m: F.lower(m["exchange"]) == exchange.strip().lower()))
    for value, column in ((min_volume, "total_volume_24h"), (min_open_interest, "total_open_interest"), (rank_from, "rank")):
        if value is not None:
            df = df.where(c(column) >= value)
    return df if rank_to is None else df.where(c("rank") <= rank_to)


def overview_page(df: DataFrame, sort: str = "rank", descending: bool = False, options: ListOptions = ListOptions()) -> DataFrame:
    """A page sorted by a listed column (rank for any other), nulls last, then symbol."""
    by = F.col(SORTS.get(sort, "rank"))
    return page(df, [by.desc_nulls_last() if descending else by.asc_nulls_last(), "symbol"], options)


def top_symbols(symbols: DataFrame, limit: int = 100) -> DataFrame:
    return symbols.where("is_active").orderBy(F.col("rank").asc_nulls_last(), "symbol").limit(limit)


def watched(symbols: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Symbols on an active watchlist row."""
    return symbols.join(watchlist.where("is_active").select("symbol_id"), "symbol_id", "left_semi")


def resolve_symbols(symbols: DataFrame, lookups: DataFrame, column: str = "lookup") -> DataFrame:
    """For each lookup text the best symbol of that name or base asset, in any case: active, then best rank, then name."""
    names = symbols.select("*", F.explode(F.array_distinct(F.array(F.upper("symbol"), F.upper("base_asset")))).alias("_alias"))
    found = lookups.select(column).distinct().join(names, F.upper(F.trim(column)) == F.col("_alias")).drop("_alias")
    best = F.struct((~F.col("is_active")).alias("a"), F.col("rank").isNull().alias("n"), F.col("rank").alias("r"), F.col("symbol").alias("s"))
    return found.groupBy(column).agg(F.min_by(F.struct(*symbols.columns), best).alias("_s")).select(column, "_s.*")


def symbol_detail(symbol_id: int, snapshots: DataFrame, series: dict[str, DataFrame], limit: int = 100) -> dict[str, DataFrame]:
    """The symbol's newest aggregate and the newest rows of each given series."""
    options = ListOptions(symbol_id=symbol_id, limit=min(limit, 100))
    out = {"latest": latest_by_key(snapshots.where(F.col("symbol_id") == symbol_id), ["symbol_id"], "snapshot_time")}
    return out | {name: newest_rows(df, name, options) for name, df in series.items()}


def admin_list(df: DataFrame, time: str, options: ListOptions = ListOptions(), **equal) -> DataFrame:
    """A page of an operations table, newest first; further columns may be asked to equal a value."""
    rows = filtered(df, options, time, None, None)
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    key = [c for c in ("id", "issue_key", "gap_key", "exchange") if c in df.columns][:1]
    return page_by_time(rows, time, key, replace(options, descending=True))

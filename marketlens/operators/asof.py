"""Newest row per key, and as of instants.

A range join of facts and instants is quadratic within a key. Here facts and instants are one sorted stream: instants
are marker rows, and a marker looks back along the order. Keys are cut into spans of time, and the rows that the next
span may still need are copied into it, so a hot key is many tasks and no result changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import micros
from marketlens.options import DAY


def latest_by_key(df: DataFrame, keys: list[str], ts_col: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key; equal times are settled by the ties, smallest first. Combined before the shuffle."""
    order = F.struct((-micros(ts_col)).alias("_t"), *[F.col(c) for c in ties])
    rest = [c for c in df.columns if c not in keys]
    best = df.where(F.col(ts_col).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def _spanned(df: DataFrame, us: str, span: int, reach: int) -> DataFrame:
    """Rows with their span, and a copy in each later span that may look back to them."""
    own = F.floor(F.col(us) / span)
    last = F.floor((F.col(us) + reach) / span)
    return df.withColumn("_span", F.explode(F.sequence(own.cast("long"), last.cast("long"))))


def asof_latest(facts: DataFrame, grid: DataFrame, ts_col: str, max_age: int, symbol: str = "symbol_id", venue: str = "exchange", as_of: str = "as_of", ties: tuple[str, ...] = ()) -> DataFrame:
    """For every (symbol, as_of) of the grid and every venue, the newest fact in ``[as_of - max_age, as_of]``, if any."""
    span = max(DAY, max_age)
    rest = [c for c in facts.columns if c not in (symbol, venue)]
    f = facts.where(F.col(ts_col).isNotNull()).select(symbol, venue, F.struct(*rest).alias("_row"), micros(ts_col).alias("_us"))
    f = _spanned(f, "_us", span, max_age)
    g = grid.select(symbol, as_of, micros(as_of).alias("_us")).distinct().withColumn("_span", F.floor(F.col("_us") / span).cast("long"))
    # markers only for venues that have rows in the span
    g = g.join(f.select(symbol, venue, "_span").distinct(), [symbol, "_span"])
    rows = f.withColumn(as_of, F.lit(None).cast(grid.schema[as_of].dataType)).withColumn("_marker", F.lit(0))
    rows = rows.unionByName(g.withColumn("_row", F.lit(None).cast(f.schema["_row"].dataType)).withColumn("_marker", F.lit(1)))
    order = Window.partitionBy(symbol, venue, "_span").orderBy("_us", "_marker", *[F.col(f"_row.{c}").desc() for c in ties]).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last(F.when(F.col("_marker") == 0, F.struct("_row", "_us")), ignorenulls=True).over(order))
    found = found.where("_marker = 1").where(F.col("_us") - F.col("_found._us") <= max_age)
    return found.select(symbol, as_of, venue, "_found._row.*")

"""Statistics over trailing windows at many instants, in work that is linear in facts and instants.

Facts are added up once into buckets of one minute and, from these, into a ladder of wider ones. A window is covered by
the few widest buckets that lie in it and, where its ends do not fall on a minute, by the facts of the two minutes at
its ends. Instants meet buckets by equality, so neither a sliding frame nor a range join is made, and a hot key is as
many groups as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import micros
from marketlens.options import DAY, HOUR, MINUTE

#: Widths of the buckets; each divides the next.
LADDER = (MINUTE, 5 * MINUTE, 15 * MINUTE, HOUR, 4 * HOUR, DAY)


@dataclass(frozen=True)
class Stat:
    """A statistic in mergeable parts: the parts of a group of facts (which have their time as ``_us``), how parts with
    a given column name are merged, and the value that they come to."""

    parts: Mapping[str, Column]
    merge: Mapping[str, Callable[[Callable[[str], Column]], Column]]
    value: Callable[[Callable[[str], Column]], Column]


def _same(agg: Callable[[Column], Column], first: Column, value=lambda c: c("v")) -> Stat:
    return Stat({"v": first}, {"v": lambda c: agg(c("v"))}, value)


def total(x: Column) -> Stat:
    return _same(F.sum, F.sum(x))


def count(x: Column) -> Stat:
    return _same(F.sum, F.count(x), lambda c: F.coalesce(c("v"), F.lit(0)).cast("long"))


def lowest(x: Column) -> Stat:
    return _same(F.min, F.min(x))


def highest(x: Column) -> Stat:
    return _same(F.max, F.max(x))


def first(x: Column, where: Column) -> Stat:
    """x of the earliest fact for which the condition holds."""
    at = F.when(where, F.col("_us"))
    return Stat({"v": F.min_by(x, at), "t": F.min(at)}, {"v": lambda c: F.min_by(c("v"), c("t")), "t": lambda c: F.min(c("t"))}, lambda c: c("v"))


def last(x: Column, where: Column) -> Stat:
    """x of the latest fact for which the condition holds."""
    at = F.when(where, F.col("_us"))
    return Stat({"v": F.max_by(x, at), "t": F.max(at)}, {"v": lambda c: F.max_by(c("v"), c("t")), "t": lambda c: F.max(c("t"))}, lambda c: c("v"))


def _apart(values: Column, gap: float, largest: bool) -> Column:
    """Of sorted values, the first and all up to the third one that lies a gap from the second, which lies a gap from it."""
    off = lambda a, b: (a - b if largest else b - a) >= gap
    after = lambda rows, last: F.filter(rows, lambda v: off(last, v))
    second = lambda rows: after(rows, F.try_element_at(rows, F.lit(1)))
    # a sorted array and what follows its first value stand in one-row arrays, so that each is worked out once
    known = F.transform(F.array(values), lambda rows: F.struct(rows.alias("rows"), F.size(second(second(rows))).alias("left")))
    return F.transform(known, lambda k: F.slice(k["rows"], 1, F.size(k["rows"]) - F.greatest(k["left"] - 1, F.lit(0))))[0]


def levels(x: Column, largest: bool, gap: float = 1e-9) -> Stat:
    """The lowest value, the lowest that lies at least ``gap`` above it, and the lowest that lies so above that one (or the
    same from the largest down): an array of at most three.

    What is kept of a bucket is enough for any window, however many values lie within a gap: all values below a gap over
    the second level, and the third. A window's first level is not above a bucket's own, so its second is not above the
    bucket's second, and neither is its third. Mostly these are three values; never more than lie in two gaps, and one.
    """
    kept = lambda values: _apart(F.sort_array(values, asc=not largest), gap, largest)

    def value(c):
        off = lambda a, b: (a - b if largest else b - a) >= gap
        rows = F.coalesce(c("v"), F.array().cast("array<double>"))
        second = F.filter(rows, lambda v: off(F.try_element_at(rows, F.lit(1)), v))
        third = F.filter(second, lambda v: off(F.try_element_at(second, F.lit(1)), v))
        return F.array_compact(F.array(*[F.try_element_at(a, F.lit(1)) for a in (rows, second, third)]))

    return Stat({"v": kept(F.collect_set(x))}, {"v": lambda c: kept(F.array_distinct(F.flatten(F.collect_list(c("v")))))}, value)


def moments(x: Column) -> Stat:
    """Number, mean and sum of squared deviations, as a struct; buckets' moments are merged pairwise, without taking a
    large square from another."""
    part = F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"].isNull() | (b["n"] == 0), a).when(a["n"] == 0, b).otherwise(both)

    # sorted, so that the order of arrival leaves no trace; as many as a window or bucket has parts
    return Stat({"v": part}, {"v": lambda c: F.aggregate(F.array_sort(F.collect_list(c("v"))), zero, join)}, lambda c: F.coalesce(c("v"), zero))


def _down(x: Column, width: int) -> Column:
    """x / width rounded down, in whole numbers."""
    return ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")


def _up(x: Column, width: int) -> Column:
    return -_down(-x, width)


def _cover(lo: Column, hi: Column) -> Column:
    """Array of (level, node): the fewest buckets that lie in (lo, hi]."""
    none = F.array().cast("array<long>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    at = lambda level: lambda x: F.struct(F.lit(level).alias("_level"), x.alias("_node"))
    out = []
    for level, width in enumerate(LADDER):
        a, b = _up(lo, width), _down(hi, width)
        if level + 1 < len(LADDER):
            wider = LADDER[level + 1]
            up_a, up_b = _up(lo, wider) * (wider // width), _down(hi, wider) * (wider // width)
            nodes = F.when(up_a < up_b, F.concat(run(a, up_a), run(up_b, b))).otherwise(run(a, b))
        else:
            nodes = run(a, b)
        out.append(F.transform(nodes, at(level)))
    return F.concat(*out)


def _leaf(us) -> Column:
    """The minute (k, k + 1] in which a time lies."""
    return _up(us, LADDER[0]) - 1


def window_stats(facts: DataFrame, grid: DataFrame, ts_col: str, windows: Mapping[str, int], stats: Mapping[str, Stat], keys: tuple[str, ...] = ("symbol_id",), as_of: str = "as_of", closed: bool = False) -> DataFrame:
    """One row per grid row and window: keys, as_of, window and the stats over the facts in ``(as_of - w, as_of]``, or
    with ``closed`` in ``[as_of - w, as_of]``."""
    names = [(s, p, f"_{s}_{p}") for s, stat in stats.items() for p in stat.parts]
    column = lambda s: lambda p: F.col(f"_{s}_{p}")
    parts = [stats[s].parts[p].alias(c) for s, p, c in names]
    merged = [stats[s].merge[p](column(s)).alias(c) for s, p, c in names]

    f = facts.where(F.col(ts_col).isNotNull()).withColumn("_us", micros(ts_col))
    leaves = f.groupBy(*keys, _leaf(F.col("_us")).alias("_node")).agg(*parts)
    at = F.array(*[F.struct(F.lit(k).alias("_level"), _down(F.col("_node"), w // LADDER[0]).alias("_node")) for k, w in enumerate(LADDER)])
    nodes = leaves.select(*keys, F.explode(at).alias("_at"), *[c for _, _, c in names]).groupBy(*keys, F.col("_at._level").alias("_level"), F.col("_at._node").alias("_node")).agg(*merged)

    each = F.explode(F.array(*[F.struct(F.lit(label).alias("window"), F.lit(w).cast("long").alias("w")) for label, w in windows.items()]))
    asked = grid.select(*keys, as_of).distinct().select(*keys, as_of, each.alias("_w"))
    group = [*keys, as_of, "window"]
    asked = asked.select(*keys, as_of, "_w.window", micros(as_of).alias("_hi"), (micros(as_of) - F.col("_w.w") - (1 if closed else 0)).alias("_lo"))
    inside = asked.select(*group, F.explode(_cover(F.col("_lo"), F.col("_hi"))).alias("_c")).select(*group, "_c.*").join(nodes, [*keys, "_level", "_node"]).select(*group, *[c for _, _, c in names])

    # the minutes that a window enters or leaves midway
    cut = lambda c: F.when(F.col(c) % LADDER[0] != 0, _down(F.col(c), LADDER[0]))
    ends = F.array_distinct(F.array_compact(F.array(cut("_lo"), cut("_hi"))))
    edges = asked.select(*group, "_lo", "_hi", F.explode(ends).alias("_node"))
    edges = edges.join(f.withColumn("_node", _leaf(F.col("_us"))), [*keys, "_node"]).where("_us > _lo and _us <= _hi").groupBy(*group).agg(*parts)

    # windows without facts have rows, too
    empty = asked.select(*group, *[F.lit(None).cast(inside.schema[c].dataType).alias(c) for _, _, c in names])
    out = empty.unionByName(inside).unionByName(edges).groupBy(*group).agg(*merged)
    return out.select(*group, *[stat.value(column(s)).alias(s) for s, stat in stats.items()])

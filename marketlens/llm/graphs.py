"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import written


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours (a > b) under the smallest of them. A node with one link keeps it; only
    the others are joined with their minimum."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = edges.join(low.where("n > 1").select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b), by alternating large and small stars.

    Each round hangs a node's larger neighbours, then its smaller ones, under its smallest neighbour, until every
    component is one star. Minima are combined before the shuffle and joined back, so a node with very many neighbours
    is no task's burden; links never leave the executors.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(_small_star(written(edges, "links")), "links")  # written first: the links may be dear to make
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(_small_star(large.where("a <> b").distinct()), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hashed (shuffled, repeatable) order, sent ``max_repeats`` times over. A
document's virtual finish time is the source's cumulative words up to its end divided by the source's target. All
documents of all sources are range-sorted by finish time, and the sort is cut where the total budget is spent; the
virtual time of the cut then says how many words of each source's queue are in the mix, the last document in part.

Running sums never see a whole source in one task: a source is cut into 1024 slices of its hash order, and the global
order into slices of virtual time.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, sorted last; a source or table
without words takes 0 with target 0; rows with equal doc_id and text are told apart by nothing and get equal hashes, so
their order among each other is arbitrary, yet they are equal rows; an empty table gives no rows; a very long text
counts whole, and where the mix takes whole documents, it is taken or not as a whole; other columns, of any name, are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import SLICES, hash_slice, running_sums, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
_VERSION = 20  # seed of the shuffle


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target of each source: the budget shared by weight, no target over max_repeats times its
    source's size, the excess reshared by weight.

    The share of a source is min(cap, weight * level); the level is found in closed form by running sums over the
    sources sorted by cap / weight, in exact integers. One row a source, so the sums over all sources are small.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    exact = "decimal(38,0)"
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every).cast(exact) * budget_percent / 100)
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(exact))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source in this order whose cap is above its share of what is left; it and all later ones get that share
    s = s.withColumn("above", F.col("cap").cast("double") * F.col("open") > F.col("left").cast("double") * F.col("weight"))
    level = F.min(F.when(F.col("above"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), (F.col("left").cast("double") / F.col("open")).alias("level")))).over(every)["level"]
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), F.xxhash64(F.lit(_VERSION), "doc_id", "text").alias("h"))
    # written, as each is read several times: the plan of all of them in one takes too much of the driver's memory
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, weights, budget_percent, max_repeats), "mix-targets")
    of = targets.select(F.col("source").alias("_s"), "source_size", "target")
    queued = running_sums(sizes, ["source"], ["h", "doc_id"], "size", "ahead", hash_slice("h"))
    queued = written(queued.join(of, queued["source"].eqNullSafe(F.col("_s"))).drop("_s"), "mix-queues")
    # every round of a source starts where the one before it ended
    sent = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("round"))
    finish = F.when(F.col("target") > 0, (F.col("ahead") + F.col("round") * F.col("source_size") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    # at time 1 every target is met, so what finishes later lies beyond the cut
    sent = sent.withColumn("finish", finish).where("size > 0 and finish <= 1").select("source", "h", "doc_id", "round", "size", "finish")
    # global order by finish time, in slices of virtual time
    sliced = sent.withColumn("slice", F.floor(F.col("finish") * SLICES).cast("long"))
    totals = sliced.groupBy("slice").agg(F.sum("size").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("slice")
    totals = totals.withColumn("to", F.sum("n").over(order)).withColumn("from", F.col("to") - F.col("n"))
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget"))
    # the one slice in which the budget runs out, and in it the first finish time at which it has
    last = totals.crossJoin(F.broadcast(budget)).where("`to` >= budget - 0.5 and `from` < budget - 0.5").select("slice", "from", "budget")
    inside = sliced.join(F.broadcast(last), "slice").withColumn("sum", F.col("from") + F.sum("size").over(Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "round")))
    cut = written(inside.where("sum >= budget - 0.5").agg(F.min("finish").alias("cut")), "mix-cut")
    # the last document may run past the budget; targets are what the budget comes to, so time never passes 1
    allowed = F.floor(F.least(F.coalesce(F.col("cut"), F.lit(1.0)), F.lit(1.0)) * F.col("target") + 0.5)
    out = queued.crossJoin(F.broadcast(cut))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), allowed - F.col("ahead") - k * F.col("source_size"))) for k in range(max_repeats)), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("target") > 0, taken).otherwise(0).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix repeats them: each as often as it is taken in whole; one that the cut takes in part is
    kept when at least half of it is taken."""
    names = docs.columns
    identity = F.xxhash64("doc_id", "text", "source")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), identity.alias("_id"))
    counts = mix(docs.select(identity.alias("doc_id"), "source", "text"), **options)
    # rows of one identity share what is taken of all of them: each as often as goes into all, the rest to the first ones
    whole = F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.max("size")).cast("long")).otherwise(0)
    counts = written(counts.groupBy(F.col("doc_id").alias("_id")).agg(whole.alias("_whole"), F.count(F.lit(1)).alias("_copies")), "mix-counts")
    row = row.join(counts.where("_whole > 0"), "_id")
    alone = row.where("_copies = 1").select("_row", F.col("_whole").alias("_times"))
    many = row.where("_copies > 1").groupBy("_id", F.xxhash64("_row").alias("_at")).agg(F.first("_row").alias("_row"), F.first("_whole").alias("_whole"), F.first("_copies").alias("_copies"), F.count(F.lit(1)).alias("_equal"))
    many = running_sums(many, ["_id"], ["_at"], "_equal", "_before", hash_slice("_at"))
    rest = F.least(F.greatest(F.col("_whole") % F.col("_copies") - F.col("_before"), F.lit(0)), F.col("_equal"))
    many = many.select("_row", (F.floor(F.col("_whole") / F.col("_copies")) * F.col("_equal") + rest).alias("_times"))
    both = alone.unionByName(many).where("_times > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_k")).select("_row.*")

"""Approximate nearest neighbours with robust-pruned directed graphs.

Vectors are dealt by hashed id into shards of a bounded size. In each shard, greedy beam searches from the shard's
medoid propose neighbours for a batch of vectors; robust pruning keeps a proposed neighbour unless one already kept is
closer to it by a factor (so long edges in new directions survive); back edges are added and pruned the same way.
Queries go to every shard in blocks and are answered by beam search; each shard returns its nearest, and the nearest of
all shards win. All rows are indexed and nothing is sampled.

The final scores are cosines in double precision of the original vectors, each scaled by its largest component first,
for all nodes of a beam. Vectors of a shard that are equal (or of the same direction to the last bit) are one node with
several ids, so any number of copies costs the graph nothing and ties go to the smaller id.

Defined cases: null or empty vectors, zero vectors and those with a null or non-finite component take no part, neither
as queries nor as candidates; vectors of different dimension never meet; repeated rows with the same id are candidates
of each other's queries no more than the row itself; equal scores go to the smaller id; a vector of very many
components is one like any other; an empty table, or one without queries, gives no rows; other columns, of any name, are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import record_batch, tidy, written

NEIGHBOURS = 5
#: Vectors of a shard, about.
SHARD_ROWS = 4096
#: Most edges of a node, beam widths for building and searching, pruning factor.
DEGREE, BUILD_BEAM, SEARCH_BEAM, FACTOR = 32, 64, 160, 1.2
#: Nodes that a search step expands at once; rows searched or inserted together; queries of a block.
EXPANDED, BATCH, BLOCK = 4, 256, 512


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and distances (1 - cosine), nearest first, that greedy searches for unit queries end with; -1 pads."""
    m, n = len(queries), len(x)
    beam = min(beam, n)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 1 - queries @ x[start], False
    seen[:, start] = True
    each = np.arange(m)[:, None]
    live = np.arange(m)
    width = min(EXPANDED, beam)
    while live.size:
        d = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(d, width - 1, axis=1)[:, :width] if width < beam else np.broadcast_to(np.arange(beam), d.shape)
        ok = np.isfinite(np.take_along_axis(d, pick, 1))
        done[live[:, None], pick] = True
        near = graph[np.where(ok, ids[live[:, None], pick], 0)].reshape(live.size, -1)
        near = np.where(np.repeat(ok, graph.shape[1], axis=1), near, -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        # the same node may be reached by two of the expanded ones
        order = np.argsort(near, axis=1, kind="stable")
        back = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], back[:, 1:] == back[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        nd = np.full(near.shape, np.inf, np.float32)
        nd[r, c] = 1 - np.einsum("ij,ij->i", queries[live[r]], x[near[r, c]])
        all_d = np.concatenate([dist[live], nd], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.broadcast_to(np.arange(all_d.shape[1]), all_d.shape)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), keep, 1) | ~np.isfinite(dist[live])
        live = live[~done[live].all(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[each, order], dist[each, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, factor: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours (-1 pads) of each own node out of its candidates, sorted by distance."""
    m, c = ids.shape
    open_ = (ids >= 0) & (ids != own[:, None]) & np.isfinite(dist)
    between = 1 - np.matmul(x[np.maximum(ids, 0)], x[np.maximum(ids, 0)].transpose(0, 2, 1))
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    for k in range(degree):
        first = open_.argmax(axis=1)
        have = open_[rows, first]
        if not have.any():
            break
        out[have, k] = ids[rows, first][have]
        near = between[rows, first]
        open_ &= ~(have[:, None] & (factor * near <= dist))
        open_[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, factor: float = FACTOR, seed: int = 3) -> tuple[np.ndarray, int]:
    """Graph (n, degree) of unit vectors and the node where searches start."""
    n = len(x)
    graph = np.full((n, degree), -1)
    start = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    lo = 1
    while lo < n:
        hi = min(n, lo + min(BATCH, max(1, lo)))
        own = order[lo:hi]
        ids, dist = beam_search(x, graph, start, x[own], beam)
        graph[own] = robust_prune(x, own, ids, dist, degree, factor)
        # back edges: each neighbour's list with its new ones, pruned where it overflows
        a, b = np.repeat(own, degree), graph[own].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        nodes, first, many = np.unique(b, return_index=True, return_counts=True)
        for part in np.array_split(np.arange(nodes.size), max(1, nodes.size // BATCH)):
            if not part.size:
                continue
            wide = degree + int(many[part].max())
            ids = np.full((part.size, wide), -1)
            ids[:, :degree] = graph[nodes[part]]
            r = np.repeat(np.arange(part.size), many[part])
            c = np.arange(r.size) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            ids[r, degree + c] = a[np.repeat(first[part], many[part]) + c]
            size = (ids >= 0).sum(axis=1)
            fits = size <= degree
            packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)
            graph[nodes[part][fits]] = packed[fits, :degree]
            if not fits.all():
                over, cand = nodes[part][~fits], ids[~fits]
                d = np.where(cand >= 0, 1 - np.einsum("ij,ikj->ik", x[over], x[np.maximum(cand, 0)]), np.inf)
                by = np.argsort(d, axis=1, kind="stable")
                graph[over] = robust_prune(x, over, np.take_along_axis(cand, by, 1), np.take_along_axis(d, by, 1), degree, factor)
        lo = hi
    return graph, start


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS, search_beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of df to each row of queries, nearest first, never the query's id."""
    rows = _clean(df, id_col, vector_col)
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    shards = dims.select("dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    dealt = rows.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    flat = pa.list_(pa.float64())

    def index(table: pa.Table) -> pa.Table:
        n = len(table)
        dim = table["dim"][0].as_py()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(n, dim)
        ids = table["vec_id"].to_numpy()
        by = np.argsort(ids, kind="stable")
        v, ids = v[by], ids[by]
        # equal vectors, and those of one direction to the last bit, are one node
        _, first, of = np.unique(_unit(v), axis=0, return_index=True, return_inverse=True)
        graph, start = build(_unit(v[first]).astype(np.float32))
        # the smallest ids of each node, enough for any query
        order = np.lexsort((ids, of.ravel()))
        return pa.table({"dim": [dim], "shard": [table["shard"][0].as_py()], "nodes": [len(first)], "start": [start], "v": [v[first].tobytes()], "graph": [graph.astype("<i4").tobytes()], "node": [of.ravel()[order].astype("<i4").tobytes()], "ids": [ids[order].astype("<i8").tobytes()]}, schema=index_schema)

    index_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("nodes", pa.int32()), ("start", pa.int32()), ("v", pa.binary()), ("graph", pa.binary()), ("node", pa.binary()), ("ids", pa.binary())])
    # building a shard is much work on few bytes: shards are dealt to tasks by number, which the planner does not merge
    many = shards.agg(F.coalesce(F.sum("shards"), F.lit(1)).cast("int")).first()[0]
    dealt = dealt.repartition(max(1, many), "dim", "shard")
    indexed = written(dealt.groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, nodes int, start int, v binary, graph binary, node binary, ids binary"), "graphs")

    # blocks of queries, one copy for each shard: the stated query set against all rows
    asked = _clean(queries, id_col, vector_col).join(shards, "dim")
    total = queries.count()
    blocks = max(1, math.ceil(total / BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block", "shards").agg(F.collect_list("vec_id").alias("q"), F.flatten(F.collect_list("v")).alias("qv"))
    asked = asked.select("dim", "block", "q", "qv", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    # a shard goes to its task once and comes before the blocks that it answers
    no = lambda t: F.lit(None).cast(t)
    packed = indexed.select("dim", "shard", F.lit(-1).alias("block"), no("array<long>").alias("q"), no("array<double>").alias("qv"), "start", "v", "graph", "node", "ids")
    packed = packed.unionByName(asked.select("dim", "shard", "block", "q", "qv", no("int").alias("start"), *[no("binary").alias(c) for c in ("v", "graph", "node", "ids")]))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, unit, x, graph, ids, bounds = 0, None, None, None, None, None
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in ("dim", "block", "start", "v", "graph", "node", "ids")}
                if r["block"] < 0:
                    unit = _unit(np.frombuffer(r["v"]).reshape(-1, r["dim"]))  # in double precision; lengths far from 1 neither overflow nor vanish
                    x, start = unit.astype(np.float32), r["start"]
                    graph = np.frombuffer(r["graph"], "<i4").reshape(len(unit), -1)
                    node, ids = np.frombuffer(r["node"], "<i4"), np.frombuffer(r["ids"], "<i8")
                    bounds = np.searchsorted(node, np.arange(len(unit) + 1))
                    continue
                q, qv = b.column("q")[k].values.to_numpy(), b.column("qv")[k].values.to_numpy().reshape(-1, r["dim"])
                for lo in range(0, len(q), BATCH):
                    part = _unit(qv[lo : lo + BATCH])
                    near, _ = beam_search(x, graph, start, part.astype(np.float32), search_beam)
                    # the whole beam is scored in double precision before it is cut
                    score = np.where(near >= 0, np.einsum("ij,ikj->ik", part, unit[np.maximum(near, 0)]), -np.inf)
                    best = np.argpartition(-score, neighbours, axis=1)[:, : neighbours + 1] if score.shape[1] > neighbours + 1 else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                    edge = np.take_along_axis(score, best, 1).min(axis=1)  # nodes as near as the last one stay in
                    out = []
                    for i in range(len(part)):
                        mine = [(-float(score[i, j]), int(w)) for j in np.flatnonzero((score[i] >= edge[i]) & (near[i] >= 0)) for w in ids[bounds[near[i, j]] : min(bounds[near[i, j] + 1], bounds[near[i, j]] + neighbours + 1)] if w != q[lo + i]]
                        out += [(int(q[lo + i]), w, -s) for s, w in sorted(set(mine))[:neighbours]]
                    yield record_batch(schema, *(list(zip(*out, strict=True)) or [[], [], []]))

    found = packed.repartition(max(1, many), "dim", "shard").sortWithinPartitions("dim", "shard", "block").mapInArrow(tidy(find), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

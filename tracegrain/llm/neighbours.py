"""Nearest neighbours by vantage-point trees, one tree for each shard of the vectors.

A shard holds about `shard_rows` vectors, dealt by a hash of the id. Its tree is built once, in one task: inner nodes split their vectors at
the median distance from a vantage point, leaves hold vectors. The queries follow in batches, and each node is visited by all
queries of a batch that the triangle inequality sends there: a side is skipped if its nearest possible point, times `relax`, is
farther than the query's k-th best so far. relax = 1 is exact; more skips more.

Defined results: vectors that are null, empty, zero, of another length than `dimension`, or hold null or non-finite components take no part, neither
as queries nor as candidates; nor do rows without an id. Equal distances go to the smaller id. Rows with the same id count once, with the
smallest of their vectors. No candidates or no queries give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracegrain.session import cut_lineage

SHARD_ROWS = 4096
LEAF_ROWS = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == dimension))
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)))


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, (points, to); a pair gives the same bits in whatever block it is computed."""
    out = np.empty((len(points), len(to)))
    step = max(1, 2_000_000 // max(1, to.size))
    for i in range(0, len(points), step):
        d = points[i : i + step, None, :] - to[None, :, :]
        out[i : i + step] = np.sqrt((d * d).sum(-1))
    return out


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple:
    """("leaf", ids, vectors) or ("node", vantage id, vantage point, inside, outside), a side being (nearest, farthest, tree)."""
    if len(ids) <= leaf_rows:
        return ("leaf", ids, x)
    # The vantage point is the vector farthest from the first one: points at the rim split better.
    v = int(np.argmax(distances(x[:1], x)[0]))
    d = distances(x[v : v + 1], x)[0]
    rest = np.ones(len(ids), bool)
    rest[v] = False
    order = np.argsort(d, kind="stable")
    order = order[rest[order]]
    half = len(order) // 2
    sides = [(float(d[o[0]]), float(d[o[-1]]), build_tree(ids[o], x[o], leaf_rows)) for o in (order[:half], order[half:])]
    return ("node", ids[v : v + 1], x[v : v + 1], *sides)


class Best:
    """The k nearest so far of each query of a block, by (distance, id)."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.d = np.full((len(query_ids), k), np.inf)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        d = np.where(ids[None, :] == self.query_ids[rows, None], np.inf, d)
        d = np.concatenate([self.d[rows], d], 1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        ids = np.where(np.isinf(d), np.iinfo(np.int64).max, ids)
        order = np.lexsort((ids, d))[:, : self.k]
        self.d[rows] = np.take_along_axis(d, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return self.d[rows, -1]


SLACK = 1e-9  # of a distance, for rounding: a bound that is larger by less than this does not prune


def search(tree: tuple, q: np.ndarray, rows: np.ndarray, best: Best, relax: float) -> None:
    if not len(rows):
        return
    if tree[0] == "leaf":
        best.add(rows, tree[1], distances(q[rows], tree[2]))
        return
    _, vid, v, *sides = tree
    d = distances(q[rows], v)[:, 0]
    best.add(rows, vid, d[:, None])
    bounds = [np.maximum(np.maximum(near - d, d - far), 0.0) for near, far, _ in sides]
    first = bounds[0] <= bounds[1]  # each query takes the nearer side first
    for side, mine in ((0, first), (1, ~first), (1, first), (0, ~first)):
        go = mine & (bounds[side] * relax * (1 - SLACK) <= best.worst(rows))
        search(sides[side][2], q, rows[go], best, relax)


def _search_shards(batches: Iterator[pa.RecordBatch], k: int, relax: float, leaf_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, a shard's vectors (is_query 0) before its queries (1). Keeps one shard's vectors or its tree, and one batch of queries."""
    now, parts, tree = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        shard, asked, ids = (b.column(i).to_numpy() for i in range(3))
        x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(asked) != 0)) + 1), len(ids)]
        for a, z in zip(cuts, cuts[1:]):
            if shard[a] != now:
                now, parts, tree = shard[a], [], None
            if not asked[a]:
                parts.append((ids[a:z], x[a:z]))
                continue
            if tree is None:
                if not parts:
                    continue
                tree = build_tree(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), leaf_rows)
                parts = []
            best = Best(ids[a:z], k)
            search(tree, x[a:z], np.arange(z - a), best, relax)
            found = np.isfinite(best.d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:z], found.sum(1))), pa.array(best.ids[found]), pa.array(best.d[found])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row, nearest first.

    is_query is a condition on `vec_id`. All queries meet every shard's tree, in batches; of each tree a query keeps its k best, and those meet by query.
    """
    rows = usable(vectors, id_col, vector_col, dimension).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = cut_lineage(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("is_query"), "vec_id", "vector")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("is_query"), "vec_id", "vector")
    found = (
        held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "vec_id")
        .mapInArrow(lambda b: _search_shards(b, k, relax, leaf_rows), "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

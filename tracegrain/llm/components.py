"""Connected components of an edge table, by alternating star contraction.

Each round hangs every node's larger neighbours on its least neighbour, then its smaller ones, until only stars are left. A node's least
neighbour is a partial aggregate; it is written out before it meets the edges again, so that a join on a hot node can be split. Rounds
grow with the logarithm of the longest chain. Before and after each round a task folds its own edges into stars. Where FOLD_EDGES or fewer are
left, one task folds them all, and no round is needed: rounds over few edges are made of tasks that have nothing to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.session import cut_lineage

FOLD_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): component is the least node reachable. Nulls and loops are left out."""
    e = cut_lineage(_folded(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()))
    while True:
        if e.count() <= FOLD_EDGES:
            e = cut_lineage(_folded(e.coalesce(1)))
            break
        if _stars(e):
            break
        e = cut_lineage(_folded(_small(_large(e))))
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _folded(e: DataFrame) -> DataFrame:
    """Each task's edges, FOLD_EDGES at a time, as stars of what they connect: few edges are done with in one go, many become fewer."""
    return e.mapInArrow(_fold, "a long, b long")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= FOLD_EDGES:
            yield _star_edges(held)
            held, size = [], 0
    if size:
        yield _star_edges(held)


def _star_edges(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one other or is hung upon, not both: then each star is a component, named by its centre, the least."""
    ends = e.select(F.col("b").alias("n"), F.lit(1).alias("hung")).unionByName(e.select(F.col("a").alias("n"), F.lit(0).alias("hung")))
    node = ends.groupBy("n").agg(F.sum("hung").alias("hung"), F.min("hung").alias("least"))
    return not node.where("hung > 1 or hung > 0 and least = 0").limit(1).count()


def _large(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on the least of itself and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut_lineage(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")))
    return both.join(least, both["a"] == least["n"]).where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the least of them."""
    least = cut_lineage(e.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m")))
    hung = e.join(least, e["b"] == least["n"]).select("m", "a", "b")
    return (hung.select(F.col("m").alias("a"), "b").unionByName(hung.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import neighbours


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[10:60] = x[5]  # one vector many times: ties
    out = [(i, x[i].tolist()) for i in range(n)]
    out += [(n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 7), (n + 3, [float("nan")] * 8), (n + 4, [float("inf")] + [0.0] * 7), (n + 5, [None] + [1.0] * 7), (None, [1.0] * 8)]
    return out + [out[7], out[100]]


def brute(rows, k):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for q in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((good[c] - good[q]) ** 2).sum())), c) for c in good if c != q)[:k]
            out += [(q, r, c, s) for r, (s, c) in enumerate(d, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("shard_rows,leaf_rows", [(4096, 64), (90, 8)])
def test_exact_search(spark, shard_rows, leaf_rows):
    rows = rows_of(700)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(1)).repartition(4)
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, dimension=8, shard_rows=shard_rows, leaf_rows=leaf_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)


def test_relaxed_search_keeps_most(spark):
    rows = rows_of(700, 1)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, 10, relax=1.3, dimension=8, leaf_rows=8).collect()
    want = {(q, c) for q, _, c, _ in brute(rows, 10)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_few_or_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0] * 8), (1, [2.0] * 8)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(two, F.col("vec_id") % 100 == 0, 10, dimension=8).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(two.where("vec_id < 0"), F.col("vec_id") % 100 == 0, dimension=8).count() == 0
    assert neighbours.nearest(two.where("vec_id = 1"), F.col("vec_id") % 100 == 0, dimension=8).count() == 0


def test_pruning_skips_leaves(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 4)) + c for c in (0, 50, 100)])
    tree, seen = neighbours.build_tree(np.arange(1500), x, 16), []
    real = neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda a, b: (seen.append(len(b)), real(a, b))[1])
    best = neighbours.Best(np.array([3]), 5)
    neighbours.search(tree, x[3:4], np.arange(1), best, 1.0)
    assert sum(seen) < 700 and np.allclose(best.d[0], np.sort(real(x[3:4], x)[0])[1:6])

import math
import random

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import retention as ret, series as ops

TIMELINE = [(0, 5, 20), (1, 40, 50), (2, 2, 50), (3, 3, 60), (4, 30, 70), (5, 0, 70)]


def points(spark, stacks, timeline=TIMELINE, keys=1):
    rows = [(f"r{k}", i, float(t), float(m), float(r), p) for k in range(keys) for i, ((t, m, r), p) in enumerate(zip(timeline, stacks))]
    return spark.createDataFrame(rows, "run_id string, seq int, t double, traced double, rss double, path array<string>").withColumn("start", F.lit(20.0))


def phase_rows(df):
    return [(r["path"][-1], r["from"], r["to"], r["peak_traced"], r["peak_rss"], r["new_rss"]) for r in df.orderBy("run_id", "depth", "phase").collect()]


A, B = ["main", "run", "a"], ["main", "run", "b"]
EXPECTED = [("a", 0, 2, 40, 50, 30), ("b", 2, 4, 3, 60, 10), ("a", 4, 5, 30, 70, 10)]


@pytest.mark.parametrize("split", [False, True])
def test_phases(spark, request, split):
    if split:
        request.getfixturevalue("small_chunks")
    stacks = [A, A, B, B, A, []]
    assert phase_rows(ops.phases(points(spark, stacks), 2, start_rss="start")) == EXPECTED
    whole = phase_rows(ops.phases(points(spark, stacks), 0, start_rss="start"))
    assert [(p[0], p[1], p[2]) for p in whole] == [("main", 0, 5)]


def test_short_gaps_are_bridged(spark, small_chunks):
    stacks = [B, B, [], B, B, []]
    got = phase_rows(ops.phases(points(spark, stacks), 2, start_rss="start"))
    assert [(p[0], p[1], p[2]) for p in got] == [("b", 0, 5)]
    assert got[0][3] == 40 and got[0][4] == 70
    far = [B, [], [], [], B, B]
    assert len(phase_rows(ops.phases(points(spark, far), 2))) == 2


def brute_phases(pts, d):
    """Direct reading of the rule: grow a stretch point by point, looking at most three points ahead."""
    out, i, running = [], 0, None
    key = lambda k: tuple(pts[k][3][: d + 1]) if len(pts[k][3]) > d else None
    while i < len(pts):
        if key(i) is None:
            running = max(running, pts[i][2]) if running is not None else pts[i][2]
            i += 1
            continue
        j = i
        while True:
            step = next((s for s in (1, 2, 3) if j + s < len(pts) and key(j + s) == key(i) and all(key(j + g) is None for g in range(1, s))), None)
            if step is None:
                break
            j += step
        peak = max(p[2] for p in pts[i:j + 1])
        base = running if running is not None else pts[i][2]
        out.append((pts[i][3][d], pts[i][0], pts[j + 1][0] if j + 1 < len(pts) else pts[j][0], max(p[1] for p in pts[i:j + 1]), peak, max(0, peak - base)))
        running = max(running, peak) if running is not None else peak
        i = j + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phases_against_brute_force(spark, small_chunks, seed):
    rng = random.Random(seed)
    pts = [(float(i), float(rng.randrange(50)), float(rng.randrange(50)), rng.choice([[], ["m"], ["m", "a"], ["m", "b"], ["m", "a", "x"]])) for i in range(120)]
    df = points(spark, [p[3] for p in pts], [p[:3] for p in pts])
    for d in (0, 1):
        assert phase_rows(ops.phases(df, d)) == [tuple(p) for p in brute_phases(pts, d)]


def test_all_depths_in_small_blocks(spark, small_chunks):
    rng = random.Random(9)
    names = [["m", "a", "x", "p"], ["m", "a", "x", "q"], ["m", "a"], ["m"], [], ["m", "b", "x", "p"], ["n", "a", "x", "p"]]
    pts = [(float(i), float(rng.randrange(50)), float(rng.randrange(50)), rng.choice(names) if rng.random() < 0.5 else names[0]) for i in range(150)]
    df = points(spark, [p[3] for p in pts], [p[:3] for p in pts], keys=2)
    got = ops.phases_all_depths(df).where("run_id = 'r1'")
    rows = {d: phase_rows(got.where(F.col("depth") == d)) for d in range(4)}
    assert rows == {d: [tuple(p) for p in brute_phases(pts, d)] for d in range(4)}


def test_phases_of_unmeasured_points(spark):
    rows = [("r", 1, 1.0, None, 5, ["m"]), ("r", 2, 2.0, None, None, None), ("r", 3, 3.0, None, 9, ["m"]), ("r", 4, 4.0, 3, None, ["k", None]), ("s", 1, 1.0, 2**52 + 1, 1, [])]
    df = spark.createDataFrame(rows, "run_id string, seq int, t double, traced bigint, rss bigint, path array<string>")
    got = ops.phases(df, [0, 1]).orderBy("depth", "phase").select("run_id", "depth", "path", "from", "to", "peak_traced", "peak_rss", "points").collect()
    assert [tuple(r) for r in got] == [("r", 0, ["m"], 1.0, 4.0, None, 9, 3), ("r", 0, ["k"], 4.0, 4.0, 3, None, 1), ("r", 1, ["k", None], 4.0, 4.0, 3, None, 1)]
    assert ops.phases(df.where("seq > 9"), None).count() == 0


def test_auto_depth(spark):
    stacks = [["main", "measure", f"part{i // 10}"] for i in range(40)]
    tl = [(i, 1, 1) for i in range(40)]
    p = points(spark, stacks, tl)
    wall = spark.createDataFrame([("r0", 39.0)], "run_id string, wall double")
    assert {r["depth"] for r in ops.phases_auto(p, wall).collect()} == {2}


def test_thinning(spark, small_chunks):
    for n in (1, 2, 300, 1001):
        df = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("t"))
        kept = sorted(r["t"] for r in ops.thin(df, ["run_id"], ["t"]).collect())
        assert len(kept) <= 300 and kept[-1] == n - 1 and kept[0] == 0
        picked = sorted(r["t"] for r in ops.representative(df, ["run_id"], ["t"]).collect())
        assert picked == sorted({round(i * (n - 1) / min(59, n - 1)) for i in range(min(60, n))}) if n > 1 else [0]


@pytest.mark.parametrize("n", [9, 10, 19, 100])
def test_halving_matches_an_online_recorder(spark, n):
    kept, every, tick = [], 1, 0
    for i in range(n):
        tick += 1
        if tick < every:
            continue
        tick = 0
        kept.append(i)
        if len(kept) >= 10:
            del kept[1::2]
            tick, every = every, every * 2
    kept = sorted({*kept, n - 1})
    df = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("t"))
    assert sorted(r["t"] for r in ops.thin_halving(df, ["run_id"], ["t"], 10).collect()) == kept


def test_deltas_keep_null(spark):
    df = spark.createDataFrame([("r", 0, 10, None), ("r", 1, None, 5), ("r", 2, 30, 9)], "run_id string, t int, traced long, rss long")
    got = [(r["traced_growth"], r["rss_change"]) for r in ops.observation_deltas(df, ["run_id"], ["t"]).orderBy("t").collect()]
    assert got == [(0, None), (None, None), (None, 4)]


def retained(spark, values):
    return spark.createDataFrame([("r", "f", 1, float(i), float(v)) for i, v in enumerate(values)], "run_id string, file string, line long, t double, mb double")


def test_growth_rules(spark):
    grows = lambda v: ret.growing_lines(retained(spark, v)).first()["growing"]
    assert grows([1, 10, 20, 40]) and not grows([1, 3, 6, 10, 10, 10, 10, 10]) and not grows([1, 2, 3]) and not grows([1, 10, 20, 15, 40])


def test_window_diagnosis(spark):
    holders = spark.createDataFrame([("r", "f", 1, "global x", "list", 10, 9)], "run_id string, file string, line long, holder string, type string, items long, matching long")
    p = retained(spark, [1, 10, 20, 40, 5, 3, 2])
    first = ret.diagnose_window(p, 0, 3, holders).first()
    assert (first["status"], first["peak"], first["end"], first["holders"]) == ("growing", 40, 40, None)
    later = ret.diagnose_window(p, 3.5, 6, holders).first()
    assert (later["status"], later["peak"], later["end"], len(later["holders"])) == ("retained", 5, 2, 1)
    assert ret.diagnose_window(p, 7, 9, holders).count() == 0


def test_monotonic(spark, small_chunks):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 3, 4, 9, 8])], "g string, t int, id int")
    r = ops.increasing_violations(df, ["g"], ["t"], "id").first()
    assert (r["rows"], r["violations"]) == (7, 2) and not math.isnan(r["rows"])

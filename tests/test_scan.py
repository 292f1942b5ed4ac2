import random

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import scan as scan_module
from tracegrain.operators.scan import plan_scan, prefix_within, scan, top_k, top_k_with_rest


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):  # group 0 holds most rows; times repeat
        g = 0 if rng.random() < 0.7 else rng.randrange(1, 30)
        out.append((g, rng.randrange(60), i, rng.choice([None, rng.randrange(100)])))
    return out


def expected(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    out = {}
    for members in groups.values():
        for i, r in enumerate(members):
            before, after = [m[3] for m in members[:i]], [m[3] for m in members[i + 1:]]
            known = [v for v in before if v is not None]
            upto = [v for v in before + [r[3]] if v is not None]
            out[r[2]] = (
                before[-1] if before else None, after[0] if after else None, known[-1] if known else None,
                next((v for v in after if v is not None), None), sum(upto) if upto else None, max(upto) if upto else None, max(known) if known else None, i + 1, len(members))
    return out


def run(spark, data):
    df = spark.createDataFrame(data, "g int, t int, id int, v int")
    v = F.col("v")
    s = scan(df, ["g"], ["t", "id"], prev={"p": v}, next={"n": v}, fill={"f": v}, backfill={"b": v}, run_sum={"s": v}, run_max={"m": v}, before_max={"bm": v},
             row_number="rn", total="tot")
    return {r["id"]: (r["p"], r["n"], r["f"], r["b"], r["s"], r["m"], r["bm"], r["rn"], r["tot"]) for r in s.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_groups(spark, seed):
    data = rows(seed)
    assert run(spark, data) == expected(data)


@pytest.mark.parametrize("seed", [3, 4])
def test_split_groups_match(spark, small_chunks, seed):
    data = rows(seed)
    assert plan_scan(spark.createDataFrame(data, "g int, t int, id int, v int"), ["g"], ["t"]).splits is not None
    assert run(spark, data) == expected(data)


def test_global_scan(spark, small_chunks):
    df = spark.range(100)
    s = scan(df, [], ["id"], prev={"p": F.col("id")}, row_number="rn")
    assert sorted((r["id"], r["p"], r["rn"]) for r in s.collect()) == [(i, i - 1 if i else None, i + 1) for i in range(100)]


def test_top_k_large_and_rest(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    kept = top_k_with_rest(df, ["g"], [F.col("v").desc()], 1200, {"other": "v"}).collect()
    assert len(kept) == 2400
    for g in (0, 1):
        values = sorted((i for i in range(5000) if i % 2 == g), reverse=True)
        mine = [r for r in kept if r["g"] == g]
        assert sorted((r["v"] for r in mine), reverse=True) == values[:1200]
        assert {r["other"] for r in mine} == {sum(values[1200:])} and {r["omitted_rows"] for r in mine} == {1300}


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = top_k(df, ["g"], [F.col("v").desc()], 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("limit", [0, 7, 60, 333, 10**9])
def test_prefix_within_a_sum(spark, monkeypatch, limit):
    """Skewed values, one value in half of the rows, ties cut by the next column, a group below the limit: the prefix of a plain sort."""
    monkeypatch.setattr(scan_module, "LAST_ROWS", 3)
    monkeypatch.setattr(scan_module, "BINS", 4)
    rng = random.Random(limit)
    rows = [(g, 5 if rng.random() < 0.5 else rng.randint(-10**12, 10**12), rng.choice([rng.randint(-9, 9), rng.randint(-2**62, 2**62)]), f"n{i}", rng.randint(1, 4))
            for g, n in (("a", 150), ("b", 40), ("c", 3)) for i in range(n)]
    got = prefix_within(spark.createDataFrame(rows, "g string, v long, u long, s string, w long"), ["g"], ["v", "u", "s"], "w", limit).collect()
    want = []
    for g in "abc":
        used = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:4]):
            used += r[4]
            if used > limit:
                break
            want.append(r)
    assert sorted(map(tuple, got)) == sorted(want)

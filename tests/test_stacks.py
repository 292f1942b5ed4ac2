import random

import pytest
from pyspark.sql import functions as F

from tracegrain.functions.paths import enclosing_name, frame_origin, function_key
from tracegrain.operators import stacks as ops

FRAME = "struct<file:string,line:int,name:string,first_line:int,user:boolean>"


def f(name, line=1, user=True, file="/app/m.py", first=None):
    return (file, line, name, line if first is None else first, user)


def samples(spark, rows):
    return spark.createDataFrame([("r", t, p, w) for t, p, w in rows], f"run_id string, thread string, path array<{FRAME}>, weight long")


MAIN, LEFT, RIGHT, LEAF = f("main", 1), f("left", 5), f("right", 9), f("leaf", 12)
IMP1, IMP2 = f("_find", 1, False, "<frozen importlib._bootstrap>"), f("_load", 2, False, "<frozen importlib._bootstrap>")


def tree(df):
    out = {}
    for r in ops.with_paths(df).collect():
        out[tuple(r["path"])] = r
    return out


def test_call_tree(spark):
    s = samples(spark, [("1", [MAIN, LEFT, LEAF], 1), ("2", [MAIN, RIGHT, LEAF], 2)])
    t = tree(ops.call_tree(s))
    assert t[()]["value"] == 3 and sum(r["self"] for r in t.values()) == 3
    assert sorted(r["value"] for r in t.values() if r["name"] == "leaf") == [1, 2]
    assert tree(ops.call_tree(s, thread="2"))[()]["value"] == 2


def test_node_limit_rolls_up(spark):
    s = samples(spark, [("1", [MAIN, LEFT, LEAF], 1), ("2", [MAIN, RIGHT, LEAF], 2)])
    t = tree(ops.limit_tree(ops.call_tree(s), 2))
    root, child = t[()], next(r for k, r in t.items() if len(k) == 1)
    assert root["value"] == 3 and child["value"] == 3 and child["omitted"] == 3


def test_grouped_and_mine_views(spark):
    s = samples(spark, [("1", [MAIN, IMP1, IMP2, LEAF], 2), ("1", [MAIN, IMP1, LEFT], 1), ("1", [MAIN], 2)])
    grouped = tree(ops.call_tree(s, "grouped"))
    group = next(r for r in grouped.values() if r["name"] == "Python import system")
    assert group["value"] == 3 and grouped[()]["value"] == 5 and sum(r["self"] for r in grouped.values()) == 5
    mine = tree(ops.call_tree(s, "mine"))
    assert mine[()]["value"] == 5 and {r["name"] for r in mine.values()} == {None, "main", "leaf", "left"}
    assert ops.group_members(s).collect()[0]["members"] == 2


def test_recursion_counts_once(spark):
    h, e = f("handler", 3), f("encode", 8)
    s = samples(spark, [("1", [MAIN, h, h, h, e], 3)])
    rows = {r["name"]: r for r in ops.top_functions(s).collect()}
    assert rows["handler"]["total"] == 3 and rows["handler"]["callers"] == 1
    assert rows["encode"]["self"] == 3 and rows["main"]["self"] == 0 and rows["main"]["callers"] == 0
    key = function_key(F.struct(F.lit("/app/m.py").alias("file"), F.lit(3).alias("first_line"), F.lit("handler").alias("name")))
    n = {(r["role"], r["name"]): r["value"] for r in ops.neighbors(s, key).collect()}
    assert n == {("function", "handler"): 3, ("self", "handler"): 0, ("caller", "main"): 3, ("callee", "encode"): 3}


def test_inverted_starts_at_the_leaf(spark):
    s = samples(spark, [("1", [MAIN, LEFT, LEAF], 1), ("1", [MAIN, LEFT], 2)])
    t = tree(ops.call_tree(s, inverted=True))
    tops = {r["name"]: r["value"] for r in t.values() if r["depth"] == 1}
    assert tops == {"leaf": 1, "left": 2}


@pytest.mark.parametrize("view", ["all", "grouped", "mine"])
def test_conservation(spark, view):
    """value = self + omitted + children, and all self values add up to the root, in every view and under a limit."""
    rng = random.Random(7)
    pool = [MAIN, LEFT, RIGHT, LEAF, IMP1, IMP2, f("x", 3, False, "/v/site-packages/p/a.py")]
    s = samples(spark, [("1", [rng.choice(pool) for _ in range(rng.randint(1, 7))], rng.randint(1, 9)) for _ in range(60)])
    full = tree(ops.call_tree(s, view))
    assert sum(r["self"] for r in full.values()) == full[()]["value"]
    cut = tree(ops.limit_tree(ops.call_tree(s, view), 25))
    for key, r in cut.items():
        children = sum(c["value"] for k, c in cut.items() if len(k) == len(key) + 1 and k[:len(key)] == key)
        assert r["value"] == r["self"] + r["omitted"] + children
        assert key[:-1] in cut or key == ()


def test_hottest_path(spark):
    s = samples(spark, [("1", [MAIN, LEFT, LEAF], 50), ("1", [MAIN, RIGHT], 30), ("1", [MAIN, LEFT], 4), ("1", [MAIN, LEFT, LEAF, f("tiny", 20)], 3)])
    names = [r["name"] for r in ops.hottest_path(ops.call_tree(s)).orderBy("depth").collect()]
    assert names == ["main", "left", "leaf"]


def test_deep_chain(spark):
    """A stack of 300 frames: paths and the hottest path come whole, in rounds that grow with the logarithm."""
    chain = [f(f"n{i}", i + 1) for i in range(300)]
    s = samples(spark, [("1", chain, 90), ("1", chain[:150] + [f("side", 999)], 10), ("1", chain[:40], 1)])
    full = ops.call_tree(s)
    t = tree(full)
    assert len(t) == 302 and max(len(k) for k in t) == 300 and all(k[:-1] in t for k in t if k)
    assert [r["name"] for r in ops.hottest_path(full).orderBy("depth").collect()] == [f"n{i}" for i in range(300)]


def test_stack_cap(spark):
    s = samples(spark, [("1", [f(f"n{i}")], 1) for i in range(10)]).withColumns({"thread_name": F.lit("T"), "seq": F.monotonically_increasing_id()})
    kept = ops.stack_totals(s, ["seq"], cap=4).collect()
    assert len(kept) == 4 and kept[0]["dropped"] == 6 and kept[0]["dropped_stacks"] == 6


def test_origins(spark):
    cases = [("/app/pkg/__init__.py", True, 3, "user", "pkg/__init__.py:3"), ("<frozen runpy>", False, 1, "internal", "Python script launcher"),
             ("<frozen abc>", False, 1, "internal", "Python internals"), ("<string>", False, 1, "internal", "code run with exec() or eval()"),
             ("<attrs x>", False, 1, "internal", "generated code"), ("/v/lib/site-packages/six.py", False, 1, "library", "six (installed package)"),
             ("/usr/lib/python3.13/json/decoder.py", False, 1, "stdlib", "json (standard library)"), ("C:\\Py\\Lib\\os.py", False, 1, "stdlib", "os (standard library)"),
             ("/opt/t.py", False, 1, "library", "t.py (outside your project)")]
    df = spark.createDataFrame([c[:3] + (i,) for i, c in enumerate(cases)], "file string, user boolean, line int, i int")
    got = {r["i"]: (r["o"]["kind"], r["o"]["label"]) for r in df.select("i", frame_origin(F.col("file"), F.col("user"), F.col("line")).alias("o")).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}


def test_enclosing_names(spark):
    df = spark.createDataFrame([("Service.handle.<lambda>",), ("<genexpr>",), ("a.<locals>.b",), ("f.<listcomp>.<lambda>",)], "q string")
    assert [r[0] for r in df.select(enclosing_name(F.col("q"))).collect()] == ["Service.handle", "<module>", "a.<locals>.b", "f"]

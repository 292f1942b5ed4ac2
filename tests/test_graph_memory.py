import pytest
from pyspark.sql import functions as F

from tracegrain.operators import allocations as alloc, checks, graph, retention as ret


def test_reach_cycles_and_paths(spark):
    edges = spark.createDataFrame([("r", "a", "b", "x"), ("r", "b", "c", "y"), ("r", "c", "a", "back"), ("r", "a", "c", "z"), ("r", "q", "s", "w")], "run_id string, src string, dst string, label string")
    roots = spark.createDataFrame([("r", "a", "a")], "run_id string, node string, label string")
    r = graph.reach(roots, edges)
    assert {(x["node"], x["depth"], x["parent"], x["label"]) for x in r.nodes.collect()} == {("a", 0, None, "a"), ("b", 1, "a", "x"), ("c", 1, "a", "z")}
    assert {(x["node"], x["path"]) for x in graph.paths(r.nodes, r.nodes).collect()} == {("a", "a"), ("b", "a.x"), ("c", "a.z")}
    assert r.complete.first()["complete"] and r.complete.first()["object_count"] == 3
    assert [(x["object"], x["path"]) for x in graph.cycles(r.nodes, edges).collect()] == [("a", "a.z.back")]
    sizes = spark.createDataFrame([("r", n, "dict", 10) for n in "abcs"], "run_id string, node string, type string, bytes long")
    assert tuple(graph.footprint(r.nodes, sizes).first()[1:]) == ("dict", 3, 30)
    targets = spark.createDataFrame([("r", "c"), ("r", "s")], "run_id string, node string")
    assert {x["node"]: x["path"] for x in graph.owner_paths(r.nodes, targets).collect()} == {"c": "a.z", "s": None}


def test_paths_and_cycles_by_jumps(spark):
    """A given tree of 3,000 levels: paths and back edges need as many rounds as its depth has binary digits."""
    n = 3000
    nodes = spark.createDataFrame([("r", str(i), i, str(i - 1) if i else None, f"l{i}", 1) for i in range(n)] + [("r", "side", 5, "4", "side", 2)],
                                  "run_id string, node string, depth int, parent string, label string, rank long")
    got = {r["node"]: r["path"] for r in graph.owner_paths(nodes, spark.createDataFrame([("r", str(n - 1)), ("r", "side"), ("r", "gone")], "run_id string, node string")).collect()}
    assert got == {str(n - 1): ".".join(f"l{i}" for i in range(n)), "side": "l0.l1.l2.l3.l4.side", "gone": None}
    edges = spark.createDataFrame([("r", "2990", "7", "b"), ("r", "side", "3", "b"), ("r", "side", "5", "b"), ("r", "9", "9", "b"), ("r", "6", "side", "b"), ("r", "1", "2", "b")],
                                  "run_id string, src string, dst string, label string")
    assert sorted((r["object"], r["depth"], r["cycles"]) for r in graph.cycles(nodes, edges).collect()) == [("3", 6, 3), ("7", 2991, 3), ("9", 10, 3)]


def test_owned_nodes_share_what_is_above_them(spark, monkeypatch):
    """Fifty nodes of one owner: the labels above them are built once. Labels may be null or empty, targets repeated."""
    edges = spark.createDataFrame([("r", "a", "b", ""), ("r", "b", "c", None)] + [("r", "c", f"n{i}", f"l{i}") for i in range(50)], "run_id string, src string, dst string, label string")
    reached = graph.reach(spark.createDataFrame([("r", "a", None)], "run_id string, node string, label string"), edges, ranks=False)
    assert "rank" not in reached.nodes.columns and reached.complete.first()["object_count"] == 53
    built, stems = [], graph._stems
    monkeypatch.setattr(graph, "_stems", lambda nodes, wanted: built.append((nodes.count(), wanted.count())) or stems(nodes, wanted))
    targets = spark.createDataFrame([("r", f"n{i}") for i in range(50)] + [("r", "n0"), ("r", "b"), ("r", "a"), ("r", "gone")], "run_id string, node string")
    got = sorted((x["node"], x["path"], x["depth"]) for x in graph.owner_paths(reached.nodes, targets).collect() if x["path"] is not None)
    assert got == sorted([(f"n{i}", f".l{i}", 3) for i in [*range(50), 0]] + [("b", "", 1), ("a", "", 0)])
    assert built == [(3, 2)]


def test_limits_clear_complete(spark):
    edges = spark.createDataFrame([("r", str(i), str(i + 1), str(i + 1)) for i in range(6)], "run_id string, src string, dst string, label string")
    roots = spark.createDataFrame([("r", "0", "0")], "run_id string, node string, label string")
    assert not graph.reach(roots, edges, max_depth=3).complete.first()["complete"]
    few = graph.reach(roots, edges, max_nodes=4)
    assert not few.complete.first()["complete"] and few.nodes.count() == 4


@pytest.fixture
def records(spark):
    frame = "struct<file:string,line:int,function:string>"
    rows = [(1, 1, "PYMALLOC_MALLOC", 1, 0, 0, 2, 100, [("/app/a.py", 3, "f")], [], "request", 1), (1, 1, "MALLOC", 2, 0, 0, 1, 50, [("/lib/x.py", 1, "x"), ("/app/a.py", 4, "g")], [], "request", 2),
            (1, 1, "MMAP", 3, 0, 0, 1, 4096, [], [("o.c", 1, "new_arena")], "request", 3), (1, 1, "MALLOC", 4, 0, 0, 1, 9, [("/app/.venv/y.py", 1, "y")], [], "request", 4),
            (1, 1, "PYMALLOC_MALLOC", 1, 0, 0, 1, 10, [("/app/a.py", 3, "f")], [], "outstanding", 5)]
    df = spark.createDataFrame(rows, f"process_id long, thread_id long, allocator string, stack_id long, native_stack_id long, native_segment_generation long, n_allocations long, size long, "
                                     f"python_stack array<{frame}>, native_stack array<{frame}>, kind string, sequence long")
    return alloc.classify(df.withColumn("run_id", F.lit("r")), "/app")


def test_allocation_sites(records):
    requests = records.where("kind = 'request'")
    s = alloc.sites(requests)
    got = {r["stack_id"]: (r["domain"], r["scope"], r["requested_bytes"]) for r in s.collect()}
    assert got == {1: ("python_allocator", "target", 100), 2: ("system_allocator", "target", 50), 3: ("interpreter_arena", "external", 4096), 4: ("system_allocator", "external", 9)}
    roles = {r["stack_id"]: r["source"]["role"] if r["source"] else None for r in requests.collect()}
    assert roles == {1: "allocation_frame", 2: "traced_user_callsite", 3: None, 4: None}
    kept = alloc.capped_sites(s, cap=2)
    assert {(r["stack_id"], r["omitted_bytes"], r["summary_complete"]) for r in kept.collect()} == {(1, 4105, False), (2, 4105, False)}
    totals = {(r["all_scopes"], r["scope"], r["domain"]): r["requested_bytes"] for r in alloc.totals(s).collect()}
    assert totals[1, None, "system_allocator"] == 59 and totals[0, "target", "system_allocator"] == 50
    left = alloc.outstanding(records.where("kind = 'outstanding'"), kept).first()
    assert (left["site_kept"], left["outstanding_bytes"], left["scope"]) == (True, 10, "target")


def test_byte_budget_is_a_prefix(spark, small_chunks):
    s = spark.range(40).select(F.lit("r").alias("run_id"), F.col("id"), (F.col("id") * 10 % 7).alias("requested_bytes"), F.lit(1).alias("allocation_count"))
    rows = [(r["id"], r["requested_bytes"]) for r in s.collect()]
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    kept = alloc.within_budget(s, ["id"], 95, row_bytes=F.lit(10)).collect()
    assert {r["id"] for r in kept} == {r[0] for r in ranked[:9]}
    assert kept[0]["omitted_bytes"] == sum(r[1] for r in ranked[9:]) and kept[0]["omitted_allocations"] == 31


def test_snapshots(spark):
    frame = "struct<file:string,line:int,user:boolean,own:boolean>"
    rows = [("r", 1, 0.0, [("a", 1, True, False), ("lib", 2, False, False)], 10), ("r", 1, 0.0, [("lib", 9, False, False)], 5), ("r", 1, 0.0, [("a", 1, True, False), ("p", 1, False, True)], 99),
            ("r", 2, 1.0, [("a", 1, True, False)], 30)]
    t = ret.snapshot_totals(ret.held_by_line(spark.createDataFrame(rows, f"run_id string, snapshot int, t double, path array<{frame}>, size long")))
    assert {(r["snapshot"], r["file"], r["line"], r["bytes"]) for r in t.collect()} == {(1, "a", 1, 10), (1, None, None, 5), (2, "a", 1, 30)}
    assert ret.peak_snapshot(t).first()["snapshot"] == 2


def test_overhead_is_incomplete_without_memory(spark):
    rows = [(10, "baseline", 0, 1.0, 100, 10, 7), (10, "fast", 0, 1.1, 110, 10, 7), (10, "slow", 0, 9.0, 110, 10, 7), (10, "blind", 0, 1.0, None, 10, 7), (10, "wrong", 0, 1.0, 100, 10, 8)]
    runs = spark.createDataFrame(rows, "size int, mode string, exit_code int, wall_s double, peak_rss_bytes long, records long, checksum long")
    limits = spark.createDataFrame([(m, 1.25, 20.0, 0.25) for m in ("fast", "slow", "blind", "wrong")], "mode string, wall_ratio_max double, rss_floor_bytes double, rss_ratio double")
    assert {r["mode"]: r["status"] for r in checks.overhead_report(runs, limits).collect()} == {"baseline": "pass", "fast": "pass", "slow": "fail", "blind": "incomplete", "wrong": "fail"}


def test_gate(spark):
    cases = spark.createDataFrame([("a:1", "passed"), ("b:1", "failed"), ("c:1", "skipped"), ("c:2", "passed")], "id string, status string")
    got = checks.criteria(cases, {"1": ["a:"], "2": ["b:", "x"], "3": ["c:"], "4": ["d:"], "5": ["a:"]}, ["5"])
    assert {r["criterion"]: r["status"] for r in got.collect()} == {"1": "pass", "2": "fail", "3": "partial", "4": "unsupported", "5": "partial"}
    assert checks.gate(got).first()["gate"] == 1 and checks.case_counts(cases).first()["passed"] == 2

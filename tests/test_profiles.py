import copy
import json

import pytest
from pyspark.sql import functions as F

from tests.fixtures import FRAMES, frame_of, line, profile, stack
from tracegrain.operators.checks import allocation_backend_valid, guard_consistent, validate_profiles
from tracegrain.sources import baselines, profiles as src


def changed(path, value):
    doc = copy.deepcopy(profile())
    at = doc
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return doc


F3 = ("files", "/app/main.py", "3")
BAD = {
    "unknown schema": (changed(("schema",), 9), "schema version"),
    "text duration": (changed(("wall_s",), "5"), "wall_s"),
    "negative duration": (changed(("wall_s",), -1), "wall_s"),
    "null line": (changed(F3, None), "line entry"),
    "line zero": (profile(files={"/app/main.py": {"0": line()}}), "line number"),
    "negative time": (changed((*F3, "time_s"), -1), "line entry"),
    "text number": (changed((*F3, "samples"), "7x"), "not a JSON object with the fixed field types"),
    "bad point": (changed((*F3, "retention", "points"), [[1]]), "line entry"),
    "frame id out of range": (changed(("stacks", "samples"), [stack([0, 9], 1)]), "stacks"),
    "long stack": (changed(("stacks", "samples"), [stack([0] * 129, 1)]), "stacks"),
    "frame without user": (changed(("stacks", "frames"), [{**FRAMES[0], "user": None}]), "stacks"),
    "number as file": (changed(("stacks", "frames"), [{**FRAMES[0], "file": 5}] + FRAMES[1:]), "stacks"),
    "memory frame id": (changed(("memory_stacks", "exit", "stacks"), [{"frames": [7], "bytes": 1, "truncated": False}]), "memory_stacks"),
    "unordered timeline": (changed(("timeline",), [[1, 0, 0], [0, 0, 0], [2, 0, 0], [3, 0, 0], [4, 0, 0], [5, 0, 0]]), "timeline"),
    "null timeline point": (changed(("timeline",), [None] * 6), "timeline"),
    "timeline stack length": (changed(("timeline_stacks",), [0]), "timeline_stacks"),
    "timeline stack id": (changed(("timeline_stacks",), [0, 0, 0, 0, 0, 2]), "timeline_stacks"),
    "rss kind": (profile(rss_kind="sometimes"), "rss_kind"),
    "negative residual": (profile(native_untraced_mb=-1), "run value"),
    "negative traced calls": (profile(trace_function={"name": "f", "calls": -1, "traced_s": 1}, memory_snapshot_at_exit=False), "trace_function"),
    "exit flag with lost tracing": (profile(memory_tracing_lost_s=2.0), "exit snapshot of a partial trace"),
    "negative pause": (changed(("gc", "total_pause_s"), -1), "gc"),
    "script is a number": (profile(script=5), "script, python or gil_split"),
    "too many objects": (profile(largest_objects={"complete": True, "objects": [{"holder": "h", "type": "t", "mb": 1, "estimated": False}] * 101}), "largest_objects"),
    "monitoring": (profile(monitoring={"requested": "all", "active": True, "dropped_line_events": 0}), "monitoring"),
    "unordered observations": (profile(memory_observations=[{"t": 2, "rss_change_bytes": 1}, {"t": 1}]), "memory_observations"),
    "not JSON": ("{", "not a JSON object with the fixed field types"),
}


def diagnostics(**values):
    event = lambda i, category, actor, payload: {
        "id": i, "t": 1, "pid": 1, "thread": 1, "task": None, "actor_kind": "thread", "actor_id": actor, "source": None, "stack": [], "category": category, "payload": payload}
    base = {"schema": 1, "instrumentation": "cooperative", "trace_path": None, "dropped_events": 0, "scan_limits": {"max_nodes": 1, "max_depth": 1}, "capabilities": {},
            "events": [event("1", "shared_read", "a", {"key": "k"}), event(2, "shared_write", "a", {"key": "k"})],
            "findings": [{"id": "f", "category": "memory_growth", "severity": "warning", "confidence": "high", "status": "measured", "source": None, "workload": {}, "evidence": {"event_ids": ["1", 2]},
                          "reproduction": {"command": None, "trace_path": None}, "summary": "s"}]}
    return {**base, **values}


def test_valid_documents(spark):
    docs = [("a", profile()), ("b", profile(schema=2, stacks=..., timeline_stacks=..., memory_stacks=...)), ("c", profile(diagnostics=diagnostics())),
            ("d", profile(memory_observations=[{"t": 0, "traced_bytes": None, "traced_growth_bytes": 1, "transient_bytes": 0, "rss_bytes": 5, "rss_change_bytes": -3, "bookkeeping_bytes": None}])),
            ("e", profile(functions=..., file_hashes=..., unknown_field={"x": 1}))]
    good, bad = validate_profiles(frame_of(spark, docs))
    assert [(r["path"], r["reasons"]) for r in bad.collect()] == [] and good.count() == len(docs)


def test_rejected_documents_say_why(spark):
    docs = [(name, doc) for name, (doc, _) in BAD.items()]
    d = diagnostics()
    docs.append(("dangling", profile(diagnostics=diagnostics(findings=[{**d["findings"][0], "evidence": {"event_ids": ["9"]}}]))))
    docs.append(("twice", profile(diagnostics=diagnostics(events=[d["events"][0]] * 2, findings=[]))))
    good, bad = validate_profiles(frame_of(spark, docs))
    reasons = {r["path"]: r["reasons"] for r in bad.collect()}
    assert [r["path"] for r in good.select("path").collect()] == []
    for name, (_, reason) in BAD.items():
        assert reason in reasons[name], (name, reasons[name])
    assert reasons["dangling"] == ["event references"] and reasons["twice"] == ["event references"]


def test_tables(spark):
    p = frame_of(spark, [("a", profile())])
    assert src.lines(p).count() == 3 and src.functions(p).count() == 2 and src.retention_points(p).count() == 6 and src.held_by(p).count() == 1
    s = src.stack_samples(p).orderBy("i").collect()
    assert [f["name"] for f in s[1]["path"]] == ["main", "right", "leaf"]
    assert {(r["which"], r["bytes"]) for r in src.memory_stacks(p).collect()} == {("peak", 60_000_000), ("peak", 1_000_000), ("exit", 60_000_000)}
    t = src.timeline(p).orderBy("i").collect()
    assert [len(r["path"]) for r in t] == [3, 3, 3, 3, 3, 0] and t[4]["rss_mb"] == 70
    assert src.gc_events(p).first()["thread"] == "7"
    assert src.runs(p).first()["started_at"] is not None


def test_remapped_paths(spark):
    p = src.remap_profiles(frame_of(spark, [("a", profile())]), [("/app", "/home/me/work"), ("/app/util.py", "/shared/util.py")])
    assert src.lines(p).select("file").distinct().first()["file"] == "/home/me/work/main.py"
    files = {f["file"] for r in src.stack_samples(p).collect() for f in r["path"]}
    assert files == {"/home/me/work/main.py", "/shared/util.py"} and p.first()["script"] == "/home/me/work/main.py"


GUARD = {"status": "completed", "budget_bytes": 100 << 20, "reserve_bytes": 1, "stop_reason": None, "scope": "process_group", "supervisor_pid": 1, "profiled_pid": 2, "child_exit_code": 0,
         "peak_root_rss_bytes": 5, "peak_group_rss_bytes": 6, "last_available_bytes": 7, "last_group_rss_bytes": 6, "poll_interval_s": 0.1, "coverage": "partial", "hard_limit": None,
         "initial_memory": {"available_bytes": 400 << 20, "total_bytes": 1, "host_available_bytes": 1, "container_available_bytes": None, "container_status": "none"}, "notes": []}


@pytest.mark.parametrize("values, ok", [
    ({}, True), ({"stop_reason": "rss_budget"}, False), ({"budget_bytes": 101 << 20}, False), ({"budget_bytes": 1}, False), ({"profiled_pid": 1}, False),
    ({"status": "stopped", "stop_reason": "rss_budget", "peak_group_rss_bytes": 100 << 20}, True), ({"status": "stopped", "stop_reason": "rss_budget"}, False),
    ({"status": "stopped", "stop_reason": "system_reserve", "last_available_bytes": 1}, True), ({"status": "stopped", "stop_reason": "interrupted"}, True),
    ({"status": "stopped", "stop_reason": "because"}, False), ({"status": "stopped"}, False), ({"hard_limit": "OTHER"}, False)])
def test_guard(spark, values, ok):
    p = frame_of(spark, [("a", profile(memory_guard={**GUARD, **values}))])
    assert p.select(guard_consistent(F.col("memory_guard")).alias("ok")).first()["ok"] is ok


SITE = {"process_id": 1, "thread_id": 1, "domain": "python_allocator", "scope": "target", "requested_bytes": 1, "allocation_count": 1, "outstanding_at_capture_end_bytes": 0,
        "outstanding_at_capture_end_blocks": 0, "allocation_timestamp_ns": None, "source": None, "python_stack": None, "native_stack": [{"file": "a", "line": None, "function": "f"}]}


def backend(**site):
    capture = {"process_id": 1, "artifact": {"path": "p", "sha256": "a" * 64, "bytes": 1, "format": "x_all_allocations"}, "sites": [{**SITE, **site}]}
    return {"backend": "capture", "available": True, "domain_totals_additive": False, "availability": {"x": "y"}, "files": [capture]}


@pytest.mark.parametrize("value, ok", [
    (backend(), True), (backend(process_id=2), False), (backend(domain="heap"), False), (backend(source={"file": "f", "line": 1, "function": "g", "role": "other"}), False),
    ({"backend": "sampled", "available": False, "reason": "off"}, True), ({"backend": "sampled", "available": False}, False), ({**backend(), "domain_totals_additive": True}, False),
    ({**backend(), "files": []}, False)])
def test_allocation_backend(spark, value, ok):
    p = frame_of(spark, [("a", profile(allocation_backend=value))])
    assert p.select(allocation_backend_valid(F.col("allocation_backend")).alias("ok")).first()["ok"] is ok


def test_baselines(spark, tmp_path):
    folder = str(tmp_path / "b")
    p = frame_of(spark, [("a", profile())])
    baselines.save_baseline(p, folder, "first", "2026-01-01 00:00:00", "abc", True)
    baselines.save_baseline(p, folder, "second", "2026-01-02 00:00:00")
    baselines.save_baseline(frame_of(spark, [("a", profile(wall_s=9.0))]), folder, "first", "2026-01-03 00:00:00")
    assert [(r["baseline_name"], r["runs"], r["git_commit"]) for r in baselines.list_baselines(spark, folder).collect()] == [("first", 1, None), ("second", 1, None)]
    assert baselines.load_baseline(spark, folder, "first").first()["wall_s"] == 9.0
    names = [("../x",), ("a/b",), ("",), (".hidden",), ("x.",), ("a b",), ("ok-1.2_x",), ("a" * 81,)]
    got = spark.createDataFrame(names, "n string").select(baselines.valid_baseline_name(F.col("n")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [False] * 6 + [True, False]
    with pytest.raises(ValueError):
        baselines.save_baseline(p, folder, "a b", "2026-01-01 00:00:00")


def test_reading_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(profile(), indent=1))
    (tmp_path / "two.json").write_text("nonsense")
    good, bad = validate_profiles(src.read_profiles(spark, str(tmp_path)))
    assert good.count() == 1 and bad.count() == 1
    src.write_tables(good, str(tmp_path / "tables"))
    src.write_tables(good, str(tmp_path / "tables"))  # again: nothing doubles
    assert spark.read.parquet(str(tmp_path / "tables" / "lines")).where("run_date = '2026-01-02'").count() == 3

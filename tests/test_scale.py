"""Work that grows with the rows only: steps done once, in as many tasks as there are cores, no group in one task."""

import os
import re

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_nested_record_is_parsed_once(spark):
    from tracegrain.operators import records as ops

    raw = spark.createDataFrame([('{"id": 1, "amount": "1.50", "tags": ["a"]}',), ("[1]",), ("{",), (None,)], "value string")
    out = ops.normalize_nested(raw)
    rules = out.select(F.explode("violations").alias("reason")).groupBy("reason").count()
    for df in (out, rules):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("parse_json") + text.count("parseJson") == 1 and text.count("json_object_keys") <= 1
    assert [(r["id"], r["amount_cents"]) for r in out.where(F.size("violations") == 0).collect()] == [(1, 150)]
    assert {r["reason"]: r["count"] for r in rules.collect()}["missing id or amount"] == 3


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_run_documents_are_dealt_to_all_cores_and_parsed_once(spark):
    from tracegrain.plans import queries_documents as qd

    assert qd.documents(spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("profile_lines", "profile_annotations"):
        assert "from_json" not in plan(getattr(qd, name)(spark, FOLDER))


def test_packed_documents_keep_a_path_each_in_few_files(spark, tmp_path):
    from tracegrain.sources import profiles

    at = str(tmp_path / "packed")
    raws = ['{"schema": 3}', '{"schema": 3}', "cut off {", "two\\nlines", None] * 20
    profiles.pack_profiles(spark.createDataFrame([(r,) for r in raws], "raw string").coalesce(2), at)
    got = profiles.read_profiles(spark, at, packed=True)
    assert sorted(r["raw"] or "" for r in got.collect()) == sorted(r or "" for r in raws)
    assert got.select("run_id").distinct().count() == got.select("path").distinct().count() == len(raws)
    assert len([f for f in os.listdir(at) if f.endswith(".parquet")]) <= 2


def test_a_group_over_its_budget_is_not_joined_in_one_task(spark, monkeypatch):
    from tracegrain.operators import scan

    monkeypatch.setattr(scan, "LAST_ROWS", 10)
    rows = [("hot", i % 97, i, 1 + i % 3) for i in range(500)] + [("cold", i, i, 5) for i in range(8)]
    kept = scan.prefix_within(spark.createDataFrame(rows, "g string, o long, i long, w long"), ["g"], ["o", "i"], "w", 300)
    want, used = set(), {}
    for g, o, i, w in sorted(rows):
        used[g] = used.get(g, 0) + w
        if used[g] <= 300:
            want.add((g, i))
    assert {(r["g"], r["i"]) for r in kept.collect()} == want
    text = plan(kept)
    assert text.count("BroadcastHashJoin") >= 2 and "LeftAnti" in text  # rows of open groups stay where they are


def test_shares_of_one_run_are_not_a_window(spark):
    from tracegrain.operators import lines

    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 6), ("b", 1, 0), (None, 1, 5), ("c", 1, None)], "run_id string, line long, w long")
    got = lines.with_share(rows, "w")
    assert "Window" not in plan(got) and got.columns == ["run_id", "line", "w", "share"]
    assert sorted(got.collect(), key=str) == sorted([("a", 1, 2, 0.25), ("a", 2, 6, 0.75), ("b", 1, 0, 0.0), (None, 1, 5, 1.0), ("c", 1, None, None)], key=str)


def test_small_ranges_do_not_make_a_task_each():
    from tracegrain.sources.ranges import deal

    files = [("/a", 10_000_000), ("/b", 0), ("/c", 3_000_001)]
    whole = lambda parts: {(r.path, k) for part in parts for r in part for k in range(r.first, r.first + r.count)}
    small, bounded = deal(files, 256, 1 << 14), deal(files, 256, 1 << 14, parts_wanted=16)
    assert len(small) > 700 and len(bounded) <= 17 and whole(small) == whole(bounded)
    assert len(deal([("/a", 1 << 40)], 1 << 20, 1 << 20, parts_wanted=16)) == 1 << 13  # never more than 128 MiB a task


def test_stored_tables_are_read_by_column_and_not_sent_through_the_driver(spark):
    from tracegrain.operators import rules
    from tracegrain.session import stored

    wide = stored(spark.range(100).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"), F.expr("map('a', id)").alias("m")))
    both = wide.select("k").join(wide.groupBy("k").count(), "k", "left")
    assert "SortMergeJoin" in plan(both) and "text" not in plan(both) and both.count() == 100
    found = rules.scan_rules(spark.createDataFrame([("a.py", "def load(cur):\n    return cur.fetchall()\n")], "path string, text string"))
    assert "Scan parquet" in plan(found) and [r["code"] for r in found.collect()] == ["heap-inflation"]


def test_report_and_summary_sections_are_not_broadcast(spark):
    from tracegrain.plans import report, summary
    from tracegrain.sources import profiles

    doc = '{"schema": 3, "script": "/app/a.py", "python": "3.13", "gil_split": true, "wall_s": 1.0, "memory_mode": "fast", "files": {"/app/a.py": {"1": {"time_s": 1.0, "samples": 3}}}}'
    good = profiles.parse_profiles(spark.createDataFrame([("/runs/a.json", doc)], "path string, raw string"))
    for df in (summary.build_summary(good, "/app", "now"), report.build_report(good)):
        assert not re.search(r"BroadcastHashJoin \[run_id#\d+\], \[run_id#\d+\], LeftOuter", plan(df))

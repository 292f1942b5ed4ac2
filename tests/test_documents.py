import json

from pyspark.sql import functions as F

from tests.fixtures import frame_of, profile
from tracegrain.plans import report, summary


def test_summary_and_report(spark, tmp_path):
    p = frame_of(spark, [("/app/p.json", profile())])
    doc = summary.build_summary(p, "/app", "2026-01-03")
    s = doc.first()["summary"].asDict(True)
    assert s["profile"]["path"] == "p.json" and s["run"]["script"] == "main.py" and s["totals"]["peak_traced_mb"]["value"] == 61
    assert [(f["name"], f["samples"]) for f in s["functions"]] == [("main", 200), ("left", 5)]
    assert s["retention"]["findings"][0]["status"] == "growing" and s["retention"]["findings"][1]["status"] == "retained"
    assert [x["status"] for x in s["retention"]["findings"]][2] == "released"
    assert s["memory_stacks"]["exit"][0] == {"function": "left", "file": "main.py", "line": 8, "mb": 60.0}
    assert s["capabilities"]["exit_retention"]["status"] == "supported" and s["totals"]["tracemalloc_peak_mb"] is None
    assert any("main.py:3" in step for step in s["next_steps"])
    summary.write_summary(doc, str(tmp_path / "s"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert back[0]["format"] == summary.FORMAT and back[0]["totals"]["tracemalloc_peak_mb"] is None

    r = report.build_report(p, metric="mem_peak").first()["report"].asDict(True)
    root = next(n for n in r["tree"] if n["depth"] == 0)
    assert root["value"] == 61_000_000 and r["unit"] == "bytes" and r["growing_count"] == 1
    assert {f["name"]: (f["self"], f["total"]) for f in r["functions"]}["main"] == (0, 61_000_000)
    assert len(r["overview"]["timeline"]) == 6 and r["overview"]["top_lines"][0]["memory"] == "60.0 MB held"
    assert {t["thread"] for t in r["threads"]} == {"1", "2"}


def test_annotations(spark):
    rows = report.annotations(frame_of(spark, [("a", profile())])).collect()
    kinds = {(r["line"], r["kind"]): r for r in rows}
    assert kinds[3, "line"]["hot"] and "growing: 60.0 MB held by global rows" in kinds[3, "line"]["text"]
    assert (3, "leak") in kinds and (14, "line") in kinds and kinds[8, "function"]["text"].startswith("Σ left(): 1.00 s")


def test_watched_folder(spark, tmp_path):
    from tracegrain.streaming.refresh import watch_profiles

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps(profile()))
    (inbox / "b.json").write_text(json.dumps(profile(wall_s=-1)))
    watch_profiles(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (inbox / "c.json").write_text(json.dumps(profile(wall_s=9.0)))
    watch_profiles(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out" / "summaries")).select(F.col("totals.run_duration_s.value").alias("v")).orderBy("v").collect() == [(5.0,), (9.0,)]
    assert spark.read.json(str(tmp_path / "out" / "rejected")).count() == 1


def test_summary_tables_hold_what_the_document_leaves_out(spark):
    main = profile()["files"]
    p = frame_of(spark, [("/app/p.json", profile(files={**main, "/app/z.py": next(iter(main.values()))}, file_hashes={"/app/main.py": "x", "/app/z.py": "y"}))])
    run = p.select("run_id").first()[0]
    fresh = spark.createDataFrame([(run, "/app/main.py", "fresh"), (run, "/app/z.py", "stale")], "run_id string, file string, freshness string")
    static = spark.createDataFrame([(run, "/app/main.py", line, code, 1, "m") for line, code in [(3, "b.x"), (3, "a.x"), (99, "a.y"), (14, "a.x")]]
                                   + [(run, "/app/z.py", 3, "a.x", 1, "m")], "run_id string, file string, line int, code string, severity int, message string")
    s = summary.build_summary(p, "/app", "now", fresh=fresh, static=static, shown=1).first()["summary"].asDict(True)
    assert [f["file"] for f in s["source"]["files"]] == ["main.py"] and [(f["line"], f["code"]) for f in s["static_diagnostics"]["findings"]] == [(3, "a.x")]
    assert (s["omitted"]["files"], s["omitted"]["static_findings"]) == (1, 4)
    hot = [step for step in s["next_steps"] if "is hot" in step]
    assert [step.split()[0] for step in hot] == ["main.py:3", "main.py:3", "main.py:14"] and any("z.py" in step and "anew" in step for step in s["next_steps"])

    t = summary.summary_tables(p, fresh, static)
    assert {(r["file"], r["freshness"]) for r in t["files"].collect()} == {("/app/main.py", "fresh"), ("/app/z.py", "stale")} and {r["position"] for r in t["files"].collect()} == {0, 1}
    places = {(r["file"], r["position"]): (r["line"], r["code"], r["measured"]) for r in t["static_findings"].collect()}
    assert {k: v[:2] for k, v in places.items()} == {("/app/main.py", 1): (3, "a.x"), ("/app/main.py", 2): (3, "b.x"), ("/app/main.py", 3): (14, "a.x"), ("/app/main.py", 4): (99, "a.y"), ("/app/z.py", 1): (3, "a.x")}
    assert places["/app/z.py", 1][2] == "source changed" and places["/app/main.py", 1][2] == "hot"
    assert t["phases"].where("phase < 1").count() == 0
    whole = summary.build_summary(p, "/app", "now", fresh=fresh, static=static).first()["summary"].asDict(True)
    assert len(whole["source"]["files"]) == 2 and set(whole["omitted"].values()) == {0}
    assert t["phases"].count() >= len(whole["phases"] or [])

"""The report document of a run, and the rows an editor would draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.functions.measures import heat, process_residual_mb
from tracegrain.functions.text import function_label, leak_message, line_label, mb_text, time_split
from tracegrain.operators import retention, stacks
from tracegrain.operators.lines import threads, top_lines
from tracegrain.operators.scan import top_k
from tracegrain.operators.series import thin
from tracegrain.plans.evidence import line_facts, listed, run_facts, run_notes, run_phases, run_struct
from tracegrain.session import stored
from tracegrain.sources import profiles as src

HOT_SHARE, HOT_MB = 0.05, 10.0


def annotations(profiles: DataFrame, hot_share: float = HOT_SHARE, hot_mb: float = HOT_MB) -> DataFrame:
    """(run_id, file, line, kind, hot, text): line labels, function totals and leak warnings.

    Lines below 1% of the time are left out unless they held memory or keep growing.
    """
    runs = run_facts(profiles)
    split_known = runs.select("run_id", "gil_split")
    lines = line_facts(profiles, runs).join(split_known, "run_id")
    split = F.when(F.col("gil_split"), time_split(F.col("time_s"), F.col("python_s"), F.col("native_s"), F.col("system_s"))).otherwise(F.lit(""))
    names = F.transform("held_by", lambda h: h["holder"])
    label = line_label(F.col("time_s"), F.col("share"), split, F.col("precise"), F.col("peak_mb"), F.col("assigns"), F.col("growing"), F.col("end_mb"), names)
    hot = heat(F.col("samples"), F.col("share"), F.col("memory_mb"), F.col("growing"), hot_share=hot_share, hot_mb=hot_mb) == "hot"
    l = lines.withColumns({"text": label, "hot": hot})
    drawn = l.where((F.col("text") != "") & ((F.col("share") >= 0.01) | F.col("text").contains("▲") | F.col("growing"))).select(
        "run_id", "file", "line", F.lit("line").alias("kind"), "hot", "text")
    subject = F.coalesce(F.get("calls", F.lit(0)), F.get("assigns", F.lit(0)))
    leaks = l.where("growing").select("run_id", "file", "line", F.lit("leak").alias("kind"), F.lit(True).alias("hot"), leak_message(
        F.col("scope"), subject, F.col("held_by"), F.col("leak_runs"), F.col("end_mb")).alias("text"))
    f = src.functions(profiles).join(runs.select("run_id", "precise", "gil_split"), "run_id").where(F.col("name") != "<module>")
    fsplit = F.when(F.col("gil_split"), time_split(F.col("time_s"), F.col("python_s"), F.col("native_s"), F.col("system_s"))).otherwise(F.lit(""))
    totals = f.select("run_id", "file", F.col("first_line").alias("line"), F.lit("function").alias("kind"), F.lit(False).alias("hot"), function_label(
        F.col("name"), F.col("time_s"), fsplit, F.when(F.col("precise"), F.col("peak_mb")).otherwise(F.lit(0.0))).alias("text"))
    return drawn.unionByName(leaks).unionByName(totals)


def weighted(profiles: DataFrame, metric: str = "elapsed") -> DataFrame:
    """Stacks under a measure: seconds of time samples, or bytes of a memory snapshot (mem_peak, mem_exit)."""
    if metric in ("mem_peak", "mem_exit"):
        which = "peak" if metric == "mem_peak" else "exit"
        return src.memory_stacks(profiles).where(F.col("which") == which).select("run_id", F.lit("").alias("thread"), "path", F.col("bytes").alias("weight"))
    return src.stack_samples(profiles).withColumn("weight", stacks.sample_weight(metric))


def overview(profiles: DataFrame, runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Run values, up to 300 timeline points and the ten lines with most time."""
    best = top_lines(lines).withColumn("memory", F.when(~F.col("precise"), F.lit("")).when(F.col("growing"), F.concat(mb_text(F.coalesce("end_mb", F.lit(0.0))), F.lit(" held")))
                                       .when(F.coalesce("peak_mb", F.lit(0.0)) >= 1, F.concat(mb_text(F.col("peak_mb")), F.lit(" at peak"))).otherwise(F.lit("")))
    tops = listed(best, "top_lines", [F.col("rank")], "file", "line", "time_s", "share", "memory")
    points = listed(thin(src.timeline(profiles).select("run_id", "t", "i", "traced_mb", "rss_mb"), ["run_id"], ["t", "i"]), "timeline", [F.col("t"), F.col("i")], "t", "traced_mb", "rss_mb")
    r = run_struct(runs)
    values = runs.select("run_id", "cpu_s", "samples", process_residual_mb(r).alias("residual_mb"), "rss_kind", "rss_start_mb", "rss_end_mb", "rss_peak_mb", F.col("peak_traced_mb").alias("traced_peak_mb"))
    return values.join(points.hint("merge"), "run_id", "left").join(tops.hint("merge"), "run_id", "left").select("run_id", F.struct(*[c for c in values.columns if c != "run_id"], "timeline", "top_lines").alias("overview"))


def build_report(profiles: DataFrame, metric: str = "elapsed", view: str = "all", inverted: bool = False, thread: str | None = None, focus: Column | None = None,
                 window: tuple[float, float] | None = None, depth: int | None = None, comparison: DataFrame | None = None, rows: int = 200, nodes: int | None = None) -> DataFrame:
    """(run_id, report): what the report shows. Its tables are top lists of `rows` functions, diagnoses and phases of a run; the tree is whole unless `nodes` is given."""
    profiles = stored(profiles)  # every section reads the parsed documents
    runs = stored(run_facts(profiles))
    lines = stored(line_facts(profiles, runs))
    points, holders = src.retention_points(profiles), src.held_by(profiles)
    if window:
        found = retention.diagnose_window(points, *window, holders, limit=rows).select("run_id", "file", "line", "status", "end", "peak", "holders", "rank")
    else:
        found = retention.diagnose(lines, runs, points, holders, limit=rows).select("run_id", "file", "line", "status", "end", "peak", "holders", "rank", "evidence", "recommendations")
    diagnoses = listed(found, "diagnoses", [F.col("rank")], *[c for c in found.columns if c not in ("run_id", "rank")])
    counts = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("diagnosis_count"), F.count_if(F.col("status") == "growing").alias("growing_count"))
    s = stored(weighted(profiles, metric))
    full = stacks.call_tree(s, view, inverted, thread, focus)
    tree = listed(stacks.limit_tree(full, nodes), "tree", [F.col("depth"), -F.col("value"), F.col("key"), F.col("node")], "node", "parent", "depth", "name", "kind", "value", "self", "omitted")
    memory = src.functions(profiles).select("run_id", "file", "first_line", "peak_mb").join(runs.where("precise").select("run_id"), "run_id", "left_semi")
    fns = stacks.top_functions(s, "mine" if view == "mine" else "all", thread, focus, limit=rows, functions=memory)
    functions = listed(fns, "functions", [F.col("rank")], *[c for c in fns.columns if c not in ("run_id", "rank")])
    ph = top_k(run_phases(profiles, runs, depth), ["run_id"], [F.col("from").asc(), F.col("phase").asc()], rows)
    phases = listed(ph, "phases", [F.col("rank")], "depth", "key", "name", "file", "line", "from", "to", "seconds", "peak_traced_mb", "peak_rss_mb", "new_rss_mb")
    who = listed(threads(src.stack_samples(profiles), ["i"]), "threads", [F.col("thread")], "thread", "thread_name")
    parts = [overview(profiles, runs, lines), diagnoses, counts, tree, functions, phases, who]
    if comparison is not None:
        parts.append(comparison.select("run_id", "comparison"))
    r = run_struct(runs)
    whole = runs.select("run_id", "script", "wall_s", F.col("memory_mode").alias("mode"), run_notes(r).alias("notes"), F.col("exit_snapshot").alias("snapshot_at_exit"), "trace_function")
    whole = whole.withColumn("unit", F.lit("bytes" if metric.startswith("mem_") else "seconds"))
    doc = reduce(lambda a, b: a.join(b.hint("merge"), "run_id", "left"), parts, whole)
    return doc.select("run_id", F.struct(*[c for c in doc.columns if c != "run_id"]).alias("report"))

"""Catalogue: run-to-run comparison over two halves of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.operators import compare as ops
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query

# Files error, purchase and signup changed between the runs: their lines moved down by seven.
_SQL = ad.SQL_SAMPLES + """,
l0 AS (SELECT run_id, file, first_line, line, function AS name, count(*) AS samples, CAST(sum(weight) AS DOUBLE) / 100 AS time, CAST(sum(weight) AS DOUBLE) / 1000 AS held,
  CAST(sum(weight) FILTER (WHERE event_id % 2 = 0) AS DOUBLE) / 1000 AS ex FROM samples GROUP BY ALL),
l AS (SELECT run_id, file, name, line % 10 AS d, line + CASE WHEN run_id = 'cur' AND file NOT IN ('view', 'click') THEN 7 ELSE 0 END AS line,
  first_line + CASE WHEN run_id = 'cur' AND file NOT IN ('view', 'click') THEN 7 ELSE 0 END AS def_line, samples, time, held, coalesce(ex, 0) AS ex,
  CASE WHEN line % 10 IN (3, 6) THEN 'a' || CAST(line % 10 AS VARCHAR) WHEN line % 10 IN (4, 5) THEN 'dup' END AS sig FROM l0),
f AS (SELECT run_id, file, name, min(def_line) AS def_line, sum(samples) AS samples, sum(time) AS time, sum(held) AS held, sum(ex) AS ex FROM l GROUP BY ALL)"""


def _verdict(a: str, b: str, noise: str) -> str:
    return f"""CASE WHEN {a} IS NULL THEN 'new' WHEN {b} IS NULL THEN 'gone' WHEN abs(coalesce({b}, 0) - coalesce({a}, 0)) <= {noise} THEN 'same'
    WHEN coalesce({b}, 0) > coalesce({a}, 0) THEN 'worse' ELSE 'better' END"""


_TN = """greatest(2 * sqrt(CASE WHEN coalesce(x.time, 0) > 0 THEN x.time * x.time / greatest(1, x.samples) ELSE 0 END + CASE WHEN coalesce(y.time, 0) > 0 THEN y.time * y.time / greatest(1, y.samples) ELSE 0 END), 0.1 * greatest(coalesce(x.time, 0), coalesce(y.time, 0)))"""
_MN = "greatest(1, 0.15 * greatest(coalesce(x.{m}, 0), coalesce(y.{m}, 0)))"


def _changes(how: str, on: str, left: str, right: str) -> str:
    return f"""SELECT coalesce(x.file, y.file) AS file, coalesce(x.name, y.name) AS name, {on},
  x.time AS tb, y.time AS tc, {_TN} AS tn, {_verdict('x.time', 'y.time', _TN)} AS tv, x.held AS hb, y.held AS hc, {_MN.format(m='held')} AS hn, {_verdict('x.held', 'y.held', _MN.format(m='held'))} AS hv,
  x.ex AS eb, y.ex AS ec, {_MN.format(m='ex')} AS en, {_verdict('x.ex', 'y.ex', _MN.format(m='ex'))} AS ev
  FROM {left} x {how} {right} y"""


_FCH = f"""fch AS ({_changes('FULL JOIN', 'x.def_line AS base_line, y.def_line AS line', "(SELECT * FROM f WHERE run_id = 'base')", "(SELECT * FROM f WHERE run_id = 'cur')")} ON x.file = y.file AND x.name = y.name)"""


def _inputs(spark, folder):
    s = ad.samples(spark, folder)
    moved = (F.col("run_id") == "cur") & ~F.col("file").isin("view", "click")
    shift = F.when(moved, 7).otherwise(0)
    digit = F.col("line") % 10
    sums = s.groupBy("run_id", "file", "first_line", "line", "function").agg(
        F.count(F.lit(1)).alias("samples"), (F.sum("weight").cast("double") / 100).alias("time"), (F.sum("weight").cast("double") / 1000).alias("held"),
        (F.sum(F.when(F.col("event_id") % 2 == 0, F.col("weight"))).cast("double") / 1000).alias("exit"))
    lines = sums.select("run_id", F.concat(F.lit("/app/"), F.col("file")).alias("file"), (F.col("line") + shift).alias("line"), "samples", "time", "held", "exit", F.lit(False).alias("leak"),
                        (F.col("first_line") + shift).alias("func_line"), F.lit(None).cast("string").alias("scope"),
                        F.when(digit.isin(3, 6), F.array(F.concat(F.lit("a"), digit.cast("string")))).when(digit.isin(4, 5), F.array(F.lit("dup"))).alias("assigns"),
                        F.lit(None).cast("array<string>").alias("calls"))
    functions = sums.select("run_id", F.concat(F.lit("/app/"), F.col("file")).alias("file"), (F.col("first_line") + shift).alias("first_line"), F.col("function").alias("name")).distinct()
    runs = _runs(s)
    sources = s.select("run_id", "file").distinct().select(
        "run_id", F.concat(F.lit("/app/"), F.col("file")).alias("file"), F.when(moved, "new").otherwise("old").alias("sha1"))
    return runs, lines, functions, sources


def _runs(s):
    """One precise whole-program run per half."""
    r = s.groupBy("run_id").agg((F.sum("weight") / 100.0).alias("wall_s"), F.max("weight").cast("double").alias("peak_traced_mb"),
                                F.sum(F.when(F.col("line") < 10, F.col("weight"))).alias("exit_total_bytes"), (F.max("weight") / 100.0).alias("rss_peak_mb"))
    null = F.lit(None)
    return r.select(
        "run_id", F.lit("/app/main.py").alias("script"), F.when(F.col("run_id") == "base", "3.12.1").otherwise("3.13.0").alias("python"), F.lit(True).alias("gil_split"), "wall_s",
        F.lit("precise").alias("memory_mode"), F.when(F.col("run_id") == "cur", 0.02).alias("interval_s"), F.lit("current").alias("rss_kind"), "peak_traced_mb", "rss_peak_mb",
        null.cast("double").alias("native_untraced_mb"), F.when(F.col("run_id") == "cur", 6).alias("frames"), null.cast("double").alias("memory_tracing_lost_s"), null.cast("string").alias("sampler_error"),
        null.cast("struct<active:boolean,reason:string>").alias("stack_sampling"), null.cast("struct<name:string>").alias("trace_function"),
        F.struct(F.array(F.col("run_id")).alias("argv"), F.lit("linux").alias("platform")).alias("run"), F.lit("process-observation").alias("memory_attribution"),
        F.lit(True).alias("memory_snapshot_at_exit"), null.cast("struct<status:string,child_exit_code:bigint,budget_bytes:bigint,reserve_bytes:bigint,hard_limit:string>").alias("memory_guard"),
        null.cast("struct<backend:string,available:boolean,files:array<struct<python_allocator_requests_traced:boolean>>>").alias("allocation_backend"),
        F.lit(False).alias("has_diagnostics"), "exit_total_bytes")


def _facts(runs):
    pairs = runs.agg(F.min("run_id").alias("base_run"), F.max("run_id").alias("cur_run"))
    return ops.pair_facts(pairs, runs)


def _flat(df, *extra):
    out = []
    for m, p in (("time", "t"), ("held", "h"), ("exit", "e")):
        out += [F.round(f"{m}.base", 6).alias(f"{p}b"), F.round(f"{m}.cur", 6).alias(f"{p}c"), F.round(f"{m}.noise", 6).alias(f"{p}n"), F.col(f"{m}.verdict").alias(f"{p}v")]
    return df.select(F.col("file_key").alias("file"), "name", *extra, *out)


_OUT = "round(tb, 6) AS tb, round(tc, 6) AS tc, round(tn, 6) AS tn, tv, round(hb, 6) AS hb, round(hc, 6) AS hc, round(hn, 6) AS hn, hv, round(eb, 6) AS eb, round(ec, 6) AS ec, round(en, 6) AS en, ev"
_SIG = """(tv IN ('better', 'worse') OR hv IN ('better', 'worse') OR ev IN ('better', 'worse') OR (tv IN ('new', 'gone') AND abs(coalesce(tc, 0) - coalesce(tb, 0)) > tn)
  OR (hv IN ('new', 'gone') AND abs(coalesce(hc, 0) - coalesce(hb, 0)) > hn) OR (ev IN ('new', 'gone') AND abs(coalesce(ec, 0) - coalesce(eb, 0)) > en))"""


@query("compare_functions", f"WITH {_SQL}, {_FCH} SELECT file, name, base_line, line, {_OUT}, {_SIG} AS significant FROM fch")
def compare_functions(spark, folder):
    runs, lines, functions, _ = _inputs(spark, folder)
    named = ops.named_lines(lines, functions, runs)
    return _flat(ops.compare_functions(_facts(runs), named), "base_line", "line", "significant")


_LINE_SQL = f"""WITH {_SQL}, {_FCH},
once AS (SELECT run_id, file, name, sig FROM l WHERE sig IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
tr AS (SELECT file, name, sig FROM once WHERE run_id = 'base' INTERSECT SELECT file, name, sig FROM once WHERE run_id = 'cur'),
k AS (SELECT l.*, CASE WHEN l.file IN ('view', 'click') THEN '@' || CAST(line AS VARCHAR) WHEN tr.sig IS NOT NULL THEN l.name || '|sig|' || l.sig ELSE l.name || '|+|' || CAST(line - def_line AS VARCHAR) END AS mk
  FROM l LEFT JOIN tr ON tr.file = l.file AND tr.name = l.name AND tr.sig = l.sig)"""
_LCH = f"""lch AS ({_changes('JOIN', 'x.line AS base_line, y.line AS line', "(SELECT * FROM k WHERE run_id = 'base')", "(SELECT * FROM k WHERE run_id = 'cur')")} ON x.file = y.file AND x.mk = y.mk)"""


@query("compare_lines", f"""{_LINE_SQL}, {_LCH},
s AS (SELECT lch.*, lch.tv IN ('better', 'worse') AND fch.tv = 'same' AS st, lch.hv IN ('better', 'worse') AND fch.hv = 'same' AS sh, lch.ev IN ('better', 'worse') AND fch.ev = 'same' AS se
  FROM lch JOIN fch ON fch.file = lch.file AND fch.name = lch.name),
z AS (SELECT * REPLACE (CASE WHEN st THEN 'same' ELSE tv END AS tv, CASE WHEN sh THEN 'same' ELSE hv END AS hv, CASE WHEN se THEN 'same' ELSE ev END AS ev),
  concat_ws(',', CASE WHEN st THEN 'time' END, CASE WHEN sh THEN 'held' END, CASE WHEN se THEN 'exit' END) AS shifted FROM s)
SELECT file, name, base_line, line, {_OUT}, shifted, {_SIG} AS significant FROM z""")
def compare_lines(spark, folder):
    runs, lines, functions, sources = _inputs(spark, folder)
    named = ops.named_lines(lines, functions, runs)
    out = ops.compare_lines(_facts(runs), named, sources)
    return _flat(out.withColumn("shifted", F.array_join("shifted", ",")), "base_line", "line", "shifted", "significant")


@query("compare_unmatched", f"""{_LINE_SQL} SELECT count(*) FILTER (WHERE run_id = 'base') AS baseline, count(*) FILTER (WHERE run_id = 'cur') AS "current"
FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.run_id <> k.run_id AND o.file = k.file AND o.mk = k.mk)""")
def compare_unmatched(spark, folder):
    runs, lines, functions, sources = _inputs(spark, folder)
    return ops.unmatched_lines(_facts(runs), ops.named_lines(lines, functions, runs), sources).select("baseline", "current")


_SITES = ad.SQL_SAMPLES + """,
st AS (SELECT run_id, CASE WHEN event_id % 3 = 0 THEN 'exit' ELSE 'peak' END AS which, CASE WHEN line % 10 = 9 THEN '' ELSE file END AS file,
  CASE WHEN line % 10 = 9 THEN 'outside your code' ELSE function END AS name, CAST(sum(weight) AS DOUBLE) / 1000 AS mb FROM samples GROUP BY ALL),
w AS (SELECT run_id, file, name, max(mb) FILTER (WHERE which = 'peak') AS peak, max(mb) FILTER (WHERE which = 'exit') AS ex FROM st GROUP BY ALL),
tops AS (SELECT run_id, arg_max(name, mb) AS top FROM st WHERE which = 'peak' GROUP BY run_id),
mv AS (SELECT count(DISTINCT top) > 1 AS moved FROM tops)"""


def _site_stacks(spark, folder):
    s = ad.samples(spark, folder)
    frame = F.struct(F.concat(F.lit("/app/"), F.col("file")).alias("file"), F.col("line"), F.concat(F.col("function"), F.lit(".<lambda>")).alias("name"), F.col("first_line"),
                     (F.col("line") % 10 != 9).alias("user"))
    lib = F.struct(F.lit("/lib/x.py").alias("file"), F.lit(1).alias("line"), F.lit("x").alias("name"), F.lit(1).alias("first_line"), F.lit(False).alias("user"))
    return s.select("run_id", F.when(F.col("event_id") % 3 == 0, "exit").otherwise("peak").alias("which"), F.array(frame, lib).alias("path"), (F.col("weight") * 1000).alias("bytes"))


@query("compare_sites", f"""WITH {_SITES},
j AS (SELECT coalesce(x.file, y.file) AS file, coalesce(x.name, y.name) AS name, x.peak IS NOT NULL OR y.peak IS NOT NULL AS hp, x.ex IS NOT NULL OR y.ex IS NOT NULL AS he,
  coalesce(x.peak, 0) AS pb, coalesce(y.peak, 0) AS pc, coalesce(x.ex, 0) AS eb, coalesce(y.ex, 0) AS ec FROM (SELECT * FROM w WHERE run_id = 'base') x FULL JOIN (SELECT * FROM w WHERE run_id = 'cur') y ON x.file = y.file AND x.name = y.name),
n AS (SELECT *, greatest(1, 0.15 * greatest(pb, pc)) AS pn, greatest(1, 0.15 * greatest(eb, ec)) AS en FROM j)
SELECT file, name, CASE WHEN hp THEN round(pb, 6) END AS peak_base, CASE WHEN hp THEN round(pc, 6) END AS peak_cur,
  CASE WHEN hp THEN CASE WHEN abs(pc - pb) <= pn THEN 'same' WHEN (SELECT moved FROM mv) THEN 'context' WHEN pc > pb THEN 'worse' ELSE 'better' END END AS peak_verdict,
  CASE WHEN he THEN round(eb, 6) END AS exit_base, CASE WHEN he THEN round(ec, 6) END AS exit_cur, CASE WHEN he THEN CASE WHEN abs(ec - eb) <= en THEN 'same' WHEN ec > eb THEN 'worse' ELSE 'better' END END AS exit_verdict FROM n""")
def compare_sites(spark, folder):
    runs = _runs(ad.samples(spark, folder))
    out = ops.compare_sites(_facts(runs), ops.site_sums(_site_stacks(spark, folder), runs))
    return out.select(F.col("file_key").alias("file"), "name", F.round("peak.base", 6).alias("peak_base"), F.round("peak.cur", 6).alias("peak_cur"), F.col("peak.verdict").alias("peak_verdict"),
                      F.round("exit.base", 6).alias("exit_base"), F.round("exit.cur", 6).alias("exit_cur"), F.col("exit.verdict").alias("exit_verdict"))


@query("compare_run", f"""WITH {ad.SQL_SAMPLES},
r AS (SELECT run_id, sum(weight) / 100.0 AS wall, CAST(max(weight) AS DOUBLE) AS traced, sum(weight) FILTER (WHERE line < 10) / 1e6 AS ex, max(weight) / 100.0 AS rss FROM samples GROUP BY run_id),
v AS (SELECT 'Run duration' AS label, x.wall AS b, y.wall AS c, greatest(0.04, 0.1 * greatest(x.wall, y.wall)) AS n FROM r x, r y WHERE x.run_id = 'base' AND y.run_id = 'cur'
  UNION ALL SELECT 'Peak traced allocations', x.traced, y.traced, greatest(1, 0.15 * greatest(x.traced, y.traced)) FROM r x, r y WHERE x.run_id = 'base' AND y.run_id = 'cur'
  UNION ALL SELECT 'Traced memory held at exit', x.ex, y.ex, greatest(1, 0.15 * greatest(x.ex, y.ex)) FROM r x, r y WHERE x.run_id = 'base' AND y.run_id = 'cur'
  UNION ALL SELECT 'Peak process RSS', x.rss, y.rss, greatest(10, 0.2 * greatest(x.rss, y.rss)) FROM r x, r y WHERE x.run_id = 'base' AND y.run_id = 'cur')
SELECT label, round(b, 6) AS base, round(c, 6) AS cur, round(n, 6) AS noise, CASE WHEN abs(c - b) <= n THEN 'same' WHEN c > b THEN 'worse' ELSE 'better' END AS verdict FROM v""")
def compare_run(spark, folder):
    out = ops.compare_runs(_facts(_runs(ad.samples(spark, folder))))
    return out.select("label", F.round("value.base", 6).alias("base"), F.round("value.cur", 6).alias("cur"), F.round("value.noise", 6).alias("noise"), F.col("value.verdict").alias("verdict"))


@query("compare_warnings", """SELECT unnest(['argv: ["base"] -> ["cur"]. Input size and code path follow the arguments, so look there first.',
'python: 3.12.1 -> 3.13.0. An upgrade alone moves object sizes and speed.',
'frames: 2 -> 6. A deeper traceback credits a block to a caller further out.',
'interval_s: 0.01 -> 0.02. The coarser run rounds every line to larger steps.']) AS warning WHERE (SELECT count(DISTINCT ts < TIMESTAMP '2024-01-16') FROM events) = 2""")
def compare_warnings(spark, folder):
    return ops.warnings(_facts(_runs(ad.samples(spark, folder)))).select(F.explode("warnings").alias("warning"))


@query("change_ranking", f"""WITH {_SQL}, {_FCH},
w AS (SELECT file, name, greatest(abs(coalesce(tc, 0) - coalesce(tb, 0)) / greatest(tn, 1e-9), abs(coalesce(hc, 0) - coalesce(hb, 0)) / greatest(hn, 1e-9), abs(coalesce(ec, 0) - coalesce(eb, 0)) / greatest(en, 1e-9)) AS weight FROM fch)
SELECT file, name, round(weight, 6) AS weight, (SELECT count(*) FROM w) AS total_rows, row_number() OVER (ORDER BY weight DESC, name, file) AS rank FROM w QUALIFY rank <= 20""")
def change_ranking(spark, folder):
    runs, lines, functions, _ = _inputs(spark, folder)
    out = ops.ranked(ops.compare_functions(_facts(runs), ops.named_lines(lines, functions, runs)), 20)
    return out.select(F.col("file_key").alias("file"), "name", F.round("weight", 6).alias("weight"), "total_rows", F.col("rank").cast("long").alias("rank"))

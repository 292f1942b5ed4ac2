"""Catalogue: a fleet of runs, one for each customer, every run compared with the next: all warnings, run rows and context rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.operators import compare as ops
from tracegrain.plans.registry import query, table

# Run values from the customer's balance in cents (h), segment and nation; null where a run did not measure something.
_FIELDS = {
    "script": "'/app/' || c_mktsegment || '.py'", "python": "'3.' || CAST(h % 4 AS {text})", "gil_split": "h % 6 = 0", "wall_s": "CAST(h AS DOUBLE) / 100",
    "memory_mode": "CASE h % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'light' ELSE 'precise' END", "interval_s": "CASE WHEN h % 4 = 0 THEN CAST(0.02 AS DOUBLE) END",
    "rss_kind": "CASE WHEN h % 13 <> 0 THEN 'current' END", "peak_traced_mb": "CASE WHEN h % 7 <> 0 THEN CAST(h % 1000 AS DOUBLE) / 10 END", "rss_peak_mb": "CAST(h % 3000 AS DOUBLE) / 10",
    "native_untraced_mb": "CASE WHEN h % 3 = 0 THEN CAST(h % 500 AS DOUBLE) / 10 END", "frames": "CASE WHEN h % 3 = 0 THEN 6 END",
    "memory_tracing_lost_s": "CASE WHEN h % 17 = 0 THEN CAST(1 AS DOUBLE) END", "sampler_error": "CASE WHEN h % 19 = 0 THEN 'lost' END",
    "memory_attribution": "'process-observation'", "memory_snapshot_at_exit": "h % 12 <> 0", "has_diagnostics": "h % 10 = 0", "exit_total_bytes": "h * 10",
    "sampling": "CASE h % 7 WHEN 0 THEN false WHEN 1 THEN true END", "reason": "CASE WHEN h % 7 = 0 AND h % 2 = 0 THEN 'no unwinder' END", "traced": "CASE WHEN h % 8 < 2 THEN 'f' || CAST(h % 2 AS {text}) END",
    "guard": "CASE h % 11 WHEN 0 THEN 'stopped' WHEN 1 THEN 'finished' WHEN 2 THEN 'finished' END", "child": "CASE h % 11 WHEN 2 THEN 1 WHEN 0 THEN 0 WHEN 1 THEN 0 END", "native": "h % 9 = 0",
    "arg": "CAST(h % 2 AS {text})", "platform": "'p' || CAST(c_nationkey % 3 AS {text})"}


def _fields(text: str) -> list[str]:
    return [f"{sql.format(text=text)} AS {name}" for name, sql in _FIELDS.items()]


def _runs(spark, folder):
    c = table(spark, folder, "customer").withColumn("h", F.round(F.abs("c_acctbal") * 100).cast("long"))
    c = c.selectExpr("c_custkey", "CAST(c_custkey AS STRING) AS run_id", "c_mktsegment", *_fields("STRING"))
    null = F.lit(None)
    return c.withColumns({
        "stack_sampling": F.when(F.col("sampling").isNotNull(), F.struct(F.col("sampling").alias("active"), "reason")), "trace_function": F.when(F.col("traced").isNotNull(), F.struct(F.col("traced").alias("name"))),
        "run": F.struct(F.array("c_mktsegment", "arg").alias("argv"), "platform"),
        "memory_guard": F.when(F.col("guard").isNotNull(), F.struct(F.col("guard").alias("status"), F.col("child").cast("long").alias("child_exit_code"), null.cast("long").alias("budget_bytes"),
                                                                    null.cast("long").alias("reserve_bytes"), null.cast("string").alias("hard_limit"))),
        "allocation_backend": F.when(F.col("native"), F.struct(F.lit("native").alias("backend"), F.lit(True).alias("available"),
                                                               F.array().cast("array<struct<python_allocator_requests_traced:boolean>>").alias("files")))})


def _facts(runs):
    pairs = runs.select(F.col("run_id").alias("base_run"), (F.col("c_custkey") + 1).cast("string").alias("cur_run"))
    return ops.pair_facts(pairs, runs)


_SQL = f"""WITH h AS (SELECT *, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS h FROM customer),
r AS (SELECT c_custkey AS k, c_mktsegment AS seg, {", ".join(_fields("VARCHAR"))} FROM h),
u AS (SELECT *, coalesce(interval_s, 0.01) AS iv, CASE WHEN memory_mode = 'precise' THEN coalesce(frames, 2) END AS depth, coalesce(NOT sampling, false) AS unsampled,
  guard IS NOT NULL AND (guard = 'stopped' OR child <> 0 OR coalesce(sampler_error, '') <> '') AS incomplete,
  memory_mode = 'precise' AND memory_tracing_lost_s IS NULL AND traced IS NULL AND memory_snapshot_at_exit AS has_exit,
  CASE WHEN memory_mode = 'precise' AND memory_tracing_lost_s IS NULL AND traced IS NULL AND native_untraced_mb > 0 THEN native_untraced_mb END AS residual FROM r),
p AS (SELECT b.k AS base, b, c, b.memory_mode = 'precise' AND c.memory_mode = 'precise' AS precise, b.has_exit AND c.has_exit AS exits, b.incomplete OR c.incomplete AS incomplete,
  b.unsampled OR c.unsampled AS unsampled, b.memory_mode = 'precise' AND c.memory_mode = 'precise' AND b.traced IS DISTINCT FROM c.traced AS scope FROM u b JOIN u c ON c.k = b.k + 1)"""

_WARNINGS = [  # condition, text
    ("b.script <> c.script", "'script: ' || b.seg || '.py -> ' || c.seg || '.py. A function counts as the same one if file and name agree; all others show up as new or gone.'"),
    ("b.seg <> c.seg OR b.arg <> c.arg", """'argv: ["' || b.seg || '","' || b.arg || '"] -> ["' || c.seg || '","' || c.arg || '"]. Input size and code path follow the arguments, so look there first.'"""),
    ("b.python <> c.python", "'python: ' || b.python || ' -> ' || c.python || '. An upgrade alone moves object sizes and speed.'"),
    ("b.platform <> c.platform", "'platform: ' || b.platform || ' -> ' || c.platform || '. Each system counts resident pages its own way.'"),
    ("b.memory_mode <> c.memory_mode", "'memory_mode: ' || b.memory_mode || ' -> ' || c.memory_mode || '. Columns that one mode lacks are empty; tracing slows code, which voids the time columns.'"),
    ("b.memory_mode = c.memory_mode AND b.depth <> c.depth", "'frames: ' || b.depth || ' -> ' || c.depth || '. A deeper traceback credits a block to a caller further out.'"),
    ("b.iv <> c.iv", "'interval_s: ' || b.iv || ' -> ' || c.iv || '. The coarser run rounds every line to larger steps.'"),
    ("b.gil_split <> c.gil_split", "'gil_split is set on one side. Without the lock signal nothing tells interpreter from native time there.'"),
    ("unsampled", "'stack_sampling off on ' || CASE WHEN b.unsampled AND c.unsampled THEN 'both sides' ELSE 'one side' END || ': ' || coalesce(CASE WHEN b.unsampled THEN b.reason ELSE c.reason END, 'unavailable') || '. Read the memory columns; seconds carry no verdict.'"),
    ("b.native <> c.native OR b.has_diagnostics <> c.has_diagnostics", "'The recorder was set up in two ways (capture backend, diagnostics or guard), and its own cost is part of what is compared.'"),
    ("coalesce(b.guard = 'stopped', false) OR coalesce(c.guard = 'stopped', false)", "'memory_guard status is stopped: at least one side holds a fraction of its work.'"),
    ("NOT exits", "'No exit snapshot to pair up, hence no exit columns.'"),
    ("scope", "'trace_function: ' || coalesce(b.traced || '()', '*') || ' -> ' || coalesce(c.traced || '()', '*') || '. Blocks made elsewhere are in one total and missing from the other.'")]


@query("fleet_warnings", _SQL + " " + " UNION ALL ".join(f"SELECT base, {text} AS warning FROM p WHERE {rule}" for rule, text in _WARNINGS))
def fleet_warnings(spark, folder):
    """Every warning of every pair of neighbouring runs; all thirteen rules occur."""
    return ops.warnings(_facts(_runs(spark, folder))).select(F.col("base_run").cast("long").alias("base"), F.explode("warnings").alias("warning"))


def _verdict(a: str, b: str, noise: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN 'new' WHEN {b} IS NULL THEN 'gone' WHEN abs({b} - {a}) <= {noise} THEN 'same' WHEN {b} > {a} THEN 'worse' ELSE 'better' END")


def _run_row(label: str, a: str, b: str, noise: str, when: str) -> str:
    return f"SELECT base, '{label}' AS label, {a} AS x, {b} AS y, {noise} AS n, scope, incomplete FROM p WHERE ({when}) AND {a} IS NOT NULL AND {b} IS NOT NULL"


def _margin(a: str, b: str, rss: bool = False) -> str:
    return f"greatest({10 if rss else 1}, {0.2 if rss else 0.15} * greatest({a}, {b}))"


_EXIT = ("CASE WHEN b.has_exit THEN b.exit_total_bytes / 1e6 END", "CASE WHEN c.has_exit THEN c.exit_total_bytes / 1e6 END")
_RUN_ROWS = " UNION ALL ".join([
    _run_row("Run duration", "b.wall_s", "c.wall_s", "greatest(2 * greatest(b.iv, c.iv), 0.1 * greatest(b.wall_s, c.wall_s))", "true"),
    _run_row("Peak traced allocations", "b.peak_traced_mb", "c.peak_traced_mb", _margin("b.peak_traced_mb", "c.peak_traced_mb"), "precise"),
    _run_row("Traced memory held at exit", *_EXIT, _margin(*_EXIT), "precise"),
    _run_row("Process RSS residual (uncertain)", "b.residual", "c.residual", _margin("b.residual", "c.residual", True), "precise"),
    _run_row("Peak process RSS", "b.rss_peak_mb", "c.rss_peak_mb", _margin("b.rss_peak_mb", "c.rss_peak_mb", True),
             "b.memory_mode <> 'off' AND c.memory_mode <> 'off' AND b.rss_kind IS NOT NULL AND c.rss_kind IS NOT NULL")])


@query("fleet_runs", f"""{_SQL}, v AS ({_RUN_ROWS}), w AS (SELECT *, {_verdict('x', 'y', 'n')} AS v FROM v)
SELECT base, label, round(x, 9) AS before, round(y, 9) AS after, round(n, 9) AS noise, CASE WHEN (scope OR incomplete) AND v IN ('better', 'worse') THEN 'context' ELSE v END AS verdict FROM w""")
def fleet_runs(spark, folder):
    """The run rows of every pair; all five labels occur, with and without context. Margins have up to eight decimals, so nine are shown."""
    v = F.col("value")
    return ops.compare_runs(_facts(_runs(spark, folder))).select(
        F.col("base_run").cast("long").alias("base"), "label", F.round(v["base"], 9).alias("before"), F.round(v["cur"], 9).alias("after"), F.round(v["noise"], 9).alias("noise"), v["verdict"].alias("verdict"))


_MEMORY = "greatest(1, 0.15 * greatest(coalesce(x.{m}, 0), coalesce(y.{m}, 0)))"
_TIME = """greatest(2 * sqrt(CASE WHEN coalesce(x.time, 0) > 0 THEN x.time * x.time / greatest(1, x.samples) ELSE 0 END + CASE WHEN coalesce(y.time, 0) > 0 THEN y.time * y.time / greatest(1, y.samples) ELSE 0 END), 0.1 * greatest(coalesce(x.time, 0), coalesce(y.time, 0)))"""
_CONTEXT_SQL = f"""{_SQL},
o AS (SELECT o_custkey AS k, o_orderpriority AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
f AS (SELECT k, name, count(*) AS samples, CAST(sum(cents) AS DOUBLE) / 1e5 AS time, CAST(max(cents) AS DOUBLE) / 1e6 AS held, CAST(min(cents) AS DOUBLE) / 1e6 AS ex, max(cents) % 7 = 0 AS leak FROM o GROUP BY ALL),
top AS (SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY held DESC, name) AS n FROM f) WHERE n = 1),
mv AS (SELECT a.k AS base FROM top a JOIN top b ON b.k = a.k + 1 WHERE a.name <> b.name),
j AS (SELECT coalesce(x.k, y.k - 1) AS base, coalesce(x.name, y.name) AS name, coalesce(y.time, 0) - coalesce(x.time, 0) AS td, {_TIME} AS tn, {_verdict('x.time', 'y.time', _TIME)} AS tv,
  coalesce(y.held, 0) - coalesce(x.held, 0) AS hd, {_MEMORY.format(m='held')} AS hn, {_verdict('x.held', 'y.held', _MEMORY.format(m='held'))} AS hv,
  coalesce(y.ex, 0) - coalesce(x.ex, 0) AS ed, {_MEMORY.format(m='ex')} AS en, {_verdict('x.ex', 'y.ex', _MEMORY.format(m='ex'))} AS ev,
  CASE WHEN coalesce(x.leak, false) AND coalesce(y.leak, false) THEN 'both' WHEN y.leak THEN 'new' WHEN x.leak THEN 'gone' END AS leak FROM f x FULL JOIN f y ON y.k = x.k + 1 AND y.name = x.name),
q AS (SELECT j.*, scope, incomplete, unsampled, precise, precise AND exits AS exits, mv.base IS NOT NULL AS moved FROM j JOIN p ON p.base = j.base LEFT JOIN mv ON mv.base = j.base),
c AS (SELECT base, name, incomplete, td, tn, hd, hn, ed, en,
  CASE WHEN (scope AND tv IN ('better', 'worse')) OR (incomplete AND tv <> 'same') OR (unsampled AND (tv <> 'same' OR td <> 0)) THEN 'context' ELSE tv END AS tv,
  CASE WHEN precise THEN CASE WHEN ((scope OR moved) AND hv IN ('better', 'worse')) OR (incomplete AND hv <> 'same') THEN 'context' ELSE hv END END AS hv,
  CASE WHEN exits THEN CASE WHEN (scope AND ev IN ('better', 'worse')) OR (incomplete AND ev <> 'same') THEN 'context' ELSE ev END END AS ev,
  CASE WHEN NOT incomplete THEN leak END AS leak FROM q)
SELECT base, name, tv AS time_verdict, hv AS held_verdict, ev AS exit_verdict, leak, NOT incomplete AND (coalesce(leak IN ('new', 'gone'), false)
  OR """ + " OR ".join(f"coalesce({v} IN ('better', 'worse') OR ({v} IN ('new', 'gone') AND abs({d}) > {n}), false)" for v, d, n in (("tv", "td", "tn"), ("hv", "hd", "hn"), ("ev", "ed", "en"))) + ") AS significant FROM c"


@query("fleet_contexts", _CONTEXT_SQL)
def fleet_contexts(spark, folder):
    """Functions of every pair with the four reasons why a change is only context: another scope, a stopped guard, no sampling, a moved peak."""
    runs = _runs(spark, folder)
    o = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    f = o.groupBy("run_id", "name").agg(
        F.count(F.lit(1)).alias("samples"), (F.sum("cents").cast("double") / 1e5).alias("time"), (F.max("cents").cast("double") / 1e6).alias("held"),
        (F.min("cents").cast("double") / 1e6).alias("exit"), (F.max("cents") % 7 == 0).alias("leak"))
    named = f.select("run_id", F.lit("/app/a").alias("file"), F.lit("a").alias("file_key"), "name", F.lit(1).alias("line"), F.lit(1).alias("def_line"), "samples", "time", "held", "exit", "leak", F.lit("[[],[]]").alias("sig"))
    sites = f.select("run_id", F.lit("peak").alias("which"), F.lit("a").alias("file_key"), "name", F.col("held").alias("mb"))
    facts = _facts(runs)
    out = ops.compare_functions(facts, named, ops.peak_moves(facts, sites))
    return out.select(F.col("base_run").cast("long").alias("base"), "name", *[F.col(f"{m}.verdict").alias(f"{m}_verdict") for m in ops.MEASURES], "leak", "significant")

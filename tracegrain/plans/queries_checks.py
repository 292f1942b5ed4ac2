"""Catalogue: checks of whole records, and the classification of allocation records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracegrain.operators import allocations as alloc, checks, events as ops
from tracegrain.plans.registry import query, table

_EVENTS = "e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))


def _struct(**fields: Column | int | str | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in fields.items()])


@query("alloc_classified", f"""WITH {_EVENTS},
d AS (SELECT *, CASE WHEN event_type = 'view' THEN 'python_allocator' WHEN k % 5 = 0 THEN 'interpreter_arena' ELSE 'system_allocator' END AS domain,
  CASE WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 2 THEN -1 WHEN user_id % 3 = 0 THEN 1 END AS hit FROM e)
SELECT event_id, domain, CASE WHEN hit IS NULL THEN 'external' WHEN hit < 0 THEN 'profiler' ELSE 'target' END AS scope,
  CASE hit WHEN 0 THEN '/app/a.py' WHEN 1 THEN '/app/main.py' END AS file, CASE hit WHEN 0 THEN k WHEN 1 THEN 7 END AS line,
  CASE WHEN hit >= 0 THEN CASE WHEN hit = 0 AND domain = 'python_allocator' THEN 'allocation_frame' ELSE 'traced_user_callsite' END END AS role FROM d""")
def alloc_classified(spark, folder):
    """Stacks of two frames: installed, own, profiler and generated code in turn."""
    k, user = F.col("k"), F.col("user_id")

    def frame(file: Column, line: Column, name: str) -> Column:
        return _struct(file=file, line=line.cast("int"), function=name)

    inner = F.when(k % 4 == 0, "/lib/x.py").when(k % 4 == 1, "/app/a.py").when(k % 4 == 2, "/prof/p.py").otherwise("/app/.venv/y.py")
    outer = F.when(user % 3 == 0, "/app/main.py").when(user % 3 == 1, "<string>").otherwise("/usr/lib/z.py")
    arena = F.array(frame(F.lit("obmalloc.c"), F.lit(1), "new_arena"))
    raw = _events(spark, folder).select(
        "event_id", F.when(F.col("event_type") == "view", "PYMALLOC_MALLOC").otherwise("MALLOC").alias("allocator"), F.array(frame(inner, k, "f"), frame(outer, F.lit(7), "g")).alias("python_stack"),
        F.when(k % 5 == 0, arena).otherwise(F.slice(arena, F.lit(1), F.lit(0))).alias("native_stack"))
    s = alloc.classify(raw, "/app", ["/prof/"])
    return s.select("event_id", "domain", "scope", F.col("source.file").alias("file"), F.col("source.line").cast("long").alias("line"), F.col("source.role").alias("role"))


@query("guard_checks", f"""WITH {_EVENTS}
SELECT event_id, k % 10 >= 5 AND user_id % 2 = 1 AND CASE event_type WHEN 'view' THEN k % 3 <> 0 WHEN 'click' THEN k % 2 = 1 WHEN 'signup' THEN k % 2 = 1 WHEN 'purchase' THEN k % 4 IN (0, 1) ELSE false END AS consistent
FROM e""")
def guard_checks(spark, folder):
    """Budgets around the least one, memory around four budgets, and every stop reason with counters that do or do not bear it out."""
    k, user, what = F.col("k"), F.col("user_id"), F.col("event_type")
    budget = F.lit(checks.MIN_BUDGET).cast("long") - 5 + k % 10
    purchase = F.when(k % 4 == 0, "interrupted").when(k % 4 == 1, "observation_unavailable: no counters").when(k % 4 == 2, "other").otherwise("")
    reason = (F.when(what == "view", F.when(k % 3 == 0, "rss_budget")).when(what == "click", "rss_budget").when(what == "signup", "system_reserve").when(what == "purchase", purchase))
    status = F.when(what == "view", "completed").when(what == "error", "crashed").otherwise("stopped")
    whole = budget * 4 - 1 + user % 2
    first = _struct(available_bytes=whole, total_bytes=whole, host_available_bytes=whole, container_available_bytes=F.lit(None).cast("long"), container_status="none")
    guard = _struct(
        status=status, scope="process_group", coverage="partial", budget_bytes=budget, reserve_bytes=F.lit(1000).cast("long"), supervisor_pid=F.col("event_id"), profiled_pid=F.col("event_id") + 1,
        last_available_bytes=F.lit(1001).cast("long") - k % 2, last_group_rss_bytes=budget, peak_group_rss_bytes=budget - 1 + k % 2, peak_root_rss_bytes=F.lit(None).cast("long"),
        child_exit_code=F.lit(0), poll_interval_s=F.lit(0.1), hard_limit=F.lit(None).cast("string"), hard_limit_bytes=F.lit(None).cast("long"), supervisor_peak_rss_bytes=F.lit(None).cast("long"),
        notes=F.array().cast("array<string>"), initial_memory=first, raw_artifacts=F.lit(None).cast("array<struct<path:string,bytes:bigint,integrity:string>>"), stop_reason=reason)
    return _events(spark, folder).select("event_id", F.coalesce(checks.guard_consistent(guard), F.lit(False)).alias("consistent"))


@query("allocation_backends", f"""WITH {_EVENTS}
SELECT event_id, CASE WHEN k % 2 = 0 THEN user_id % 4 <> 0 AND k % 3 > 0 AND user_id % 5 <> 0 AND user_id % 7 <> 0
  ELSE k % 3 = 0 OR user_id % 4 <> 0 AND k % 5 = 0 END AS valid FROM e""")
def allocation_backends(spark, folder):
    """Backends that are there, with none to two captures of one site, and backends that are not, with or without a reason."""
    k, user = F.col("k"), F.col("user_id")
    no_stack = F.lit(None).cast("array<struct<file:string,line:int,function:string>>")
    zero = F.lit(0).cast("long")
    site = _struct(
        process_id=user, thread_id=k, domain=F.when(user % 7 == 0, "other").otherwise("system_allocator"), scope="target", requested_bytes=k, allocation_count=k, outstanding_at_capture_end_bytes=zero,
        outstanding_at_capture_end_blocks=zero, allocation_timestamp_ns=F.lit(None).cast("long"), source=F.lit(None).cast("struct<file:string,function:string,line:int,role:string>"),
        python_stack=no_stack, native_stack=no_stack)
    artifact = _struct(path="capture.bin", sha256=F.when(user % 5 == 0, "short").otherwise(F.sha2(F.col("event_id").cast("string"), 256)), bytes=k, format="tool_all_allocations")
    capture = _struct(process_id=user, artifact=artifact, sites=F.array(site))
    none = F.array().cast("array<string>")
    backend = _struct(
        backend=F.when(user % 4 == 0, "sampled").otherwise("full"), available=k % 2 == 0, reason=F.when(k % 3 == 0, "not installed"), errors=F.when(k % 5 == 0, F.array(F.lit("failed"))).otherwise(none),
        domain_totals_additive=F.lit(False), availability="linux", files=F.slice(F.array(capture, capture), F.lit(1), (k % 3).cast("int")))
    return _events(spark, folder).select("event_id", F.coalesce(checks.allocation_backend_valid(backend), F.lit(False)).alias("valid"))


@query("checkpoint_cycles", """SELECT o_custkey AS id, count(*) AS cycles, 'information' AS severity FROM orders WHERE o_totalprice > 300000 GROUP BY 1""")
def checkpoint_cycles(spark, folder):
    """A customer's orders are the objects of a checkpoint; the large ones lead back to their owner."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.when(F.col("o_totalprice") > 300_000, F.col("o_orderkey"))).alias("cycles"))
    return ops.checkpoint_cycles(orders).select("id", F.size("cycles").cast("long").alias("cycles"), "severity")

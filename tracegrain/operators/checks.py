"""Acceptance rules: run documents, guards, allocation backends, overhead budgets, criteria."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.sources.profiles import CORRUPT

MODES = ("fast", "precise", "off")
LINE_NUMBERS = ("time_s", "share", "python_s", "native_s", "system_s", "samples", "rss_growth_mb", "rss_release_mb")
LINE_OPTIONAL = ("alloc_mb", "transient_peak_mb", "peak_mb", "end_mb", "leak_runs", "func_line", "profiler_mb", "cpu_unsplit_s", "line_events")
SOURCE_LIMIT = 256
MIN_BUDGET = 64 << 20


def _ok(c: Column) -> Column:
    """A rule over possibly missing values holds only when it is known to hold."""
    return F.coalesce(c, F.lit(False))


def _number(c: Column) -> Column:
    return _ok((c >= 0) & (c < F.lit(float("inf"))))  # NaN is above every number


def _optional(c: Column) -> Column:
    return c.isNull() | _number(c)


def _finite(c: Column) -> Column:
    return _ok(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _each(array: Column, rule) -> Column:
    """Every element is present and fulfils the rule; a missing array fulfils it."""
    return F.coalesce(F.forall(array, lambda x: x.isNotNull() & rule(x)), F.lit(True))


def _one_of(c: Column, values: Sequence[str]) -> Column:
    return _ok(c.isin(*values))


def _frame_ok(f: Column) -> Column:
    return f["file"].isNotNull() & f["name"].isNotNull() & f["user"].isNotNull() & _number(f["line"]) & _number(f["first_line"])


def _ids_ok(ids: Column, frames: Column, most: int) -> Column:
    return ids.isNotNull() & (F.size(ids) <= most) & _each(ids, lambda i: (i >= 0) & (i < F.size(frames)))


def _ordered(values: Column) -> Column:
    return F.coalesce(F.forall(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.coalesce(F.get(values, i) >= F.get(values, i - 1), F.lit(True))), F.lit(True))


def guard_consistent(g: Column) -> Column:
    """The budget fits the measured memory and the stop reason agrees with the counters."""
    counts = [g[c] for c in ("budget_bytes", "reserve_bytes", "supervisor_pid", "profiled_pid", "last_available_bytes", "last_group_rss_bytes")]
    first = g["initial_memory"]
    shape = (_one_of(g["status"], ("completed", "stopped")) & _one_of(g["scope"], ("process_group", "profiled_process")) & _ok(g["coverage"] == "partial")
             & _ok(g["budget_bytes"] >= MIN_BUDGET) & _ok(g["supervisor_pid"] != g["profiled_pid"]) & g["child_exit_code"].isNotNull()
             & _ok((g["poll_interval_s"] > 0) & _finite(g["poll_interval_s"])) & _optional(g["peak_root_rss_bytes"]) & _optional(g["peak_group_rss_bytes"])
             & (g["hard_limit"].isNull() | _ok(g["hard_limit"] == "RLIMIT_AS")) & _optional(g["hard_limit_bytes"]) & _optional(g["supervisor_peak_rss_bytes"])
             & g["notes"].isNotNull() & _ok(F.size(g["notes"]) <= 20) & _each(g["notes"], lambda n: n.isNotNull())
             & _optional(first["container_available_bytes"]) & first["container_status"].isNotNull())
    for c in (*counts, *[first[x] for x in ("available_bytes", "total_bytes", "host_available_bytes")]):
        shape = shape & _number(c)
    artifacts = g["raw_artifacts"].isNull() | (_ok(F.size(g["raw_artifacts"]) <= 64) & _each(
        g["raw_artifacts"], lambda a: a["path"].isNotNull() & _number(a["bytes"]) & _ok(a["integrity"] == "unverified")))
    reason = g["stop_reason"]
    why = (F.when(g["status"] == "completed", reason.isNull())
           .when(F.coalesce(reason, F.lit("")) == "", F.lit(False))
           .when(reason == "rss_budget", _ok(g["peak_group_rss_bytes"] >= g["budget_bytes"]))
           .when(reason == "system_reserve", _ok(g["last_available_bytes"] <= g["reserve_bytes"]))
           .otherwise((reason == "interrupted") | reason.startswith("observation_unavailable: ")))
    return shape & artifacts & _ok(g["budget_bytes"] * 4 <= first["available_bytes"]) & _ok(why)


def allocation_backend_valid(a: Column) -> Column:
    """An unavailable backend says why; an available one lists at most 64 captures of at most 2,048 well-formed sites."""
    def stack(s: Column) -> Column:
        return s.isNull() | ((F.size(s) <= 64) & _each(s, lambda f: f["file"].isNotNull() & f["function"].isNotNull() & _optional(f["line"])))

    def site(s: Column, f: Column) -> Column:
        src = s["source"]
        return (_ok(s["process_id"] == f["process_id"]) & _number(s["thread_id"]) & _one_of(s["domain"], ("python_allocator", "system_allocator", "interpreter_arena"))
                & _one_of(s["scope"], ("target", "profiler", "external")) & _number(s["requested_bytes"]) & _number(s["allocation_count"])
                & _number(s["outstanding_at_capture_end_bytes"]) & _number(s["outstanding_at_capture_end_blocks"]) & s["allocation_timestamp_ns"].isNull()
                & (src.isNull() | (src["file"].isNotNull() & src["function"].isNotNull() & _optional(src["line"]) & _one_of(src["role"], ("allocation_frame", "traced_user_callsite"))))
                & stack(s["python_stack"]) & stack(s["native_stack"]))

    def capture(f: Column) -> Column:
        art = f["artifact"]
        return (_number(f["process_id"]) & art["path"].isNotNull() & _ok(art["sha256"].rlike("^[a-f0-9]{64}$")) & _number(art["bytes"])
                & _ok(art["format"].endswith("_all_allocations")) & f["sites"].isNotNull() & _ok(F.size(f["sites"]) <= 2048) & _each(f["sites"], lambda s: site(s, f)))

    sampled = F.coalesce(a["backend"] == "sampled", F.lit(True))
    gone = a["reason"].isNotNull() | (~sampled & _ok(F.size(a["errors"]) > 0))
    full = (~sampled & _ok(~a["domain_totals_additive"]) & a["availability"].isNotNull() & _ok(F.size(a["files"]).between(1, 64)) & _each(a["files"], capture))
    return a["backend"].isNotNull() & a["available"].isNotNull() & F.when(a["available"], full).otherwise(gone)


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) run documents. A rejected document keeps every reason it was refused for."""
    checked = profiles.withColumn("__v", F.explode(F.array(F.try_parse_json("raw"))))

    def type_of(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("__v", path, "variant"))

    def text(path: str, required: bool = False) -> Column:
        t = type_of(path)
        return _ok(t == "STRING") if required else F.coalesce(t.isin("STRING", "VOID"), F.lit(True))

    def field_type(path: str, field: str, kind: str) -> Column:
        t = type_of(path)
        return t.isNull() | t.isin("VOID", "ARRAY<VOID>", "ARRAY<OBJECT<>>") | t.contains(f"{field}: {kind}")

    c = F.col
    entries = F.flatten(F.transform(F.map_values("files"), lambda m: F.map_values(m)))
    line_keys = F.flatten(F.transform(F.map_values("files"), lambda m: F.map_keys(m)))
    fn_entries = F.flatten(F.transform(F.map_values(F.coalesce("functions", F.create_map().cast(profiles.schema["functions"].dataType))), lambda m: F.map_values(m)))

    def entry_ok(e: Column) -> Column:
        rule = F.lit(True)
        for k in LINE_NUMBERS:
            rule = rule & _number(e[k])
        for k in LINE_OPTIONAL:
            rule = rule & _optional(e[k])
        r = e["retention"]
        points = _each(r["points"], lambda p: _ok(F.size(p) == 2) & _each(p, _number))
        kept = r.isNull() | (_number(r["snapshots"]) & _number(r["rises"]) & _number(r["releases"]) & _number(r["observed_s"]) & _optional(r["peak_mb"])
                             & _finite(r["growth_mb"]) & r["points"].isNotNull() & points)
        holders = _each(e["held_by"], lambda h: h["holder"].isNotNull() & h["type"].isNotNull() & _number(h["items"]) & _number(h["matching"]))
        return rule & kept & holders & _each(e["assigns"], lambda x: x.isNotNull()) & _each(e["calls"], lambda x: x.isNotNull())

    def function_ok(f: Column) -> Column:
        rule = f["name"].isNotNull()
        for k in ("time_s", "python_s", "native_s", "system_s", "peak_mb"):
            rule = rule & _number(f[k])
        for k in ("alloc_mb", "rss_growth_mb", "profiler_mb", "transient_peak_mb", "end_line"):
            rule = rule & _optional(f[k])
        return rule

    s, ms = c("stacks"), c("memory_stacks")

    def sample_ok(v: Column) -> Column:
        rule = v["thread"].isNotNull() & v["thread_name"].isNotNull() & _optional(v["alloc_bytes"]) & _ids_ok(v["frames"], s["frames"], 128)
        for k in ("python_s", "native_s", "system_s", "unsplit_s", "samples"):
            rule = rule & _number(v[k])
        return rule

    def table_ok(t: Column) -> Column:
        return (_number(t["t"]) & _number(t["total_bytes"]) & _number(t["other_bytes"]) & t["stacks"].isNotNull()
                & _each(t["stacks"], lambda x: _number(x["bytes"]) & x["truncated"].isNotNull() & _ids_ok(x["frames"], ms["frames"], 256)))

    tl, obs, gc, lo, mon, tf, run, d = c("timeline"), c("memory_observations"), c("gc"), c("largest_objects"), c("monitoring"), c("trace_function"), c("run"), c("diagnostics")
    times = F.transform(tl, lambda p: F.get(p, F.lit(0)))
    top_numbers = ("peak_traced_mb", "rss_peak_mb", "unattributed_peak_mb", "native_untraced_mb", "cpu_s", "samples", "interval_s", "snapshots", "rss_start_mb", "rss_end_mb",
                   "memory_tracing_lost_s", "tracemalloc_peak_mb", "process_id")
    numbers = F.lit(True)
    for k in top_numbers:
        numbers = numbers & _optional(c(k))

    def observation_ok(o: Column) -> Column:
        rule = _number(o["t"]) & (o["rss_change_bytes"].isNull() | _finite(o["rss_change_bytes"].cast("double")))
        for k in ("traced_bytes", "traced_growth_bytes", "transient_bytes", "rss_bytes", "bookkeeping_bytes"):
            rule = rule & _optional(o[k])
        return rule

    def gc_ok(e: Column) -> Column:
        rule = e["thread"].isNotNull() & _optional(e["process"]) & _optional(e["traced_bytes"])
        for k in ("t", "duration_s", "generation", "collected", "uncollectable"):
            rule = rule & _number(e[k])
        return rule

    def source_ok(x: Column) -> Column:
        return x["file"].isNotNull() & _number(x["line"]) & x["function"].isNotNull()

    def event_ok(e: Column) -> Column:
        return (e["id"].isNotNull() & _number(e["t"]) & _number(e["pid"]) & e["thread"].isNotNull() & e["actor_kind"].isNotNull() & e["actor_id"].isNotNull()
                & (e["source"].isNull() | source_ok(e["source"])) & e["stack"].isNotNull() & _ok(F.size(e["stack"]) <= SOURCE_LIMIT) & _each(e["stack"], source_ok)
                & e["category"].isNotNull() & _ok(e["payload"].startswith("{")))

    def finding_ok(f: Column) -> Column:
        return (f["id"].isNotNull() & f["category"].isNotNull() & _one_of(f["severity"], ("error", "warning", "information", "hint")) & _one_of(f["confidence"], ("high", "medium", "low"))
                & _one_of(f["status"], ("measured", "confirmed", "potential", "projected")) & (f["source"].isNull() | source_ok(f["source"])) & _ok(f["evidence"].startswith("{"))
                & _ok(f["reproduction"].startswith("{")) & f["summary"].isNotNull())

    event_ids = F.transform(d["events"], lambda e: e["id"])
    cited = F.flatten(F.transform(d["findings"], lambda f: F.coalesce(F.from_json(F.get_json_object(f["evidence"], "$.event_ids"), "array<string>"), F.array().cast("array<string>"))))
    references = (F.size(F.array_distinct(event_ids)) == F.size(event_ids)) & (F.size(F.array_except(cited, event_ids)) == 0)

    rules: list[tuple[str, Column]] = [
        ("not a JSON object with the fixed field types", c("__v").isNotNull() & _ok(type_of("$").startswith("OBJECT")) & c(CORRUPT).isNull()),
        ("schema version", _ok(c("schema").isin(2, 3))),
        ("script, python or gil_split", text("$.script", True) & text("$.python", True) & c("gil_split").isNotNull()),
        ("wall_s", _number(c("wall_s"))),
        ("memory_mode", _one_of(c("memory_mode"), MODES)),
        ("files, functions or file_hashes", c("files").isNotNull() & _each(F.map_values("files"), lambda m: m.isNotNull()) & _each(F.map_values("file_hashes"), lambda h: h.isNotNull())),
        ("run value", numbers),
        ("rss_kind", c("rss_kind").isNull() | c("rss_kind").isin("current", "peak")),
        ("sampler_error", text("$.sampler_error")),
        ("stack_sampling", c("stack_sampling").isNull() | c("stack_sampling.active").isNotNull()),
        ("timeline", tl.isNull() | (_ok(F.size(tl) <= 10_000) & _each(tl, lambda p: _ok(F.size(p) == 3) & _each(p, _number)) & _ordered(times))),
        ("line number", _each(line_keys, lambda k: k.rlike(r"^[1-9]\d*$"))),
        ("line entry", _each(entries, entry_ok)),
        ("function entry", _each(fn_entries, function_ok)),
        ("stacks", s.isNull() | (_number(s["dropped_s"]) & s["depth_limited"].isNotNull() & s["frames"].isNotNull() & _each(s["frames"], _frame_ok) & s["samples"].isNotNull()
                                 & _each(s["samples"], sample_ok) & field_type("$.stacks.frames", "file", "STRING") & field_type("$.stacks.frames", "name", "STRING"))),
        ("memory_stacks", ms.isNull() | (_ok(ms["depth"] >= 1) & ms["frames"].isNotNull() & _each(ms["frames"], _frame_ok) & ms["exit"].isNotNull() & table_ok(ms["exit"])
                                         & (ms["peak"].isNull() | table_ok(ms["peak"])))),
        ("largest_objects", lo.isNull() | (lo["complete"].isNotNull() & lo["objects"].isNotNull() & _ok(F.size(lo["objects"]) <= 100) & _optional(lo["max_depth"]) & _optional(lo["max_nodes"])
                                           & _optional(lo["visited"]) & _each(lo["objects"], lambda o: o["holder"].isNotNull() & o["type"].isNotNull() & _number(o["mb"])
                                                                              & o["estimated"].isNotNull() & _optional(o["items"])))),
        ("monitoring", mon.isNull() | (_one_of(mon["requested"], ("off", "lines")) & mon["active"].isNotNull() & _number(mon["dropped_line_events"]))),
        ("timeline_stacks", c("timeline_stacks").isNull() | (_ok(F.size("timeline_stacks") == F.coalesce(F.size(tl), F.lit(0)).cast("int")) & _each(
            c("timeline_stacks"), lambda i: (i >= -1) & (i < F.coalesce(F.size(s["samples"]), F.lit(0)))))),
        ("trace_function", tf.isNull() | (tf["name"].isNotNull() & _number(tf["calls"]) & _number(tf["traced_s"]))),
        ("run", run.isNull() | (run["argv"].isNotNull() & _each(run["argv"], lambda a: a.isNotNull()) & run["platform"].isNotNull() & _each(run["command"], lambda a: a.isNotNull()))),
        ("memory_attribution", c("memory_attribution").isNull() | (c("memory_attribution") == "process-observation")),
        ("native_memory", c("native_memory").isNull() | (_ok(c("native_memory.status") == "unavailable") & c("native_memory.reason").isNotNull() & _optional(c("native_memory.rss_residual_mb")))),
        ("exit snapshot of a partial trace", ~(_ok(c("memory_snapshot_at_exit")) & (c("memory_tracing_lost_s").isNotNull() | tf.isNotNull()))),
        ("memory_observations", obs.isNull() | (_ok(F.size(obs) <= 600) & _each(obs, observation_ok) & _ordered(F.transform(obs, lambda o: o["t"])))),
        ("gc", gc.isNull() | (gc["supported"].isNotNull() & _number(gc["total_pause_s"]) & _number(gc["dropped_events"]) & _number(gc["total_collections"]) & _number(gc["collected"])
                              & _number(gc["uncollectable"]) & gc["events"].isNotNull() & _ok(F.size(gc["events"]) <= 10_000) & _each(gc["events"], gc_ok))),
        ("diagnostics", d.isNull() | (_ok(d["schema"] == 1) & _ok(d["instrumentation"] == "cooperative") & _number(d["dropped_events"]) & _number(d["scan_limits"]["max_nodes"])
                                      & _number(d["scan_limits"]["max_depth"]) & d["capabilities"].isNotNull()
                                      & _each(F.map_values(d["capabilities"]), lambda x: _one_of(x["status"], ("supported", "partial", "unavailable")) & x["reason"].isNotNull())
                                      & d["events"].isNotNull() & _ok(F.size(d["events"]) <= 100_000) & _each(d["events"], event_ok) & d["findings"].isNotNull()
                                      & _ok(F.size(d["findings"]) <= 10_000) & _each(d["findings"], finding_ok) & (d["trace_sha256"].isNull() | d["trace_sha256"].rlike("^[a-f0-9]{64}$"))
                                      & _optional(d["dropped_findings"]) & _optional(d["dropped_labels"]))),
        ("event references", d.isNull() | _ok(references)),
        ("allocation_backend", c("allocation_backend").isNull() | _ok(allocation_backend_valid(c("allocation_backend")))),
        ("memory_guard", c("memory_guard").isNull() | _ok(guard_consistent(c("memory_guard")))),
    ]
    reasons = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules]))
    out = checked.withColumn("reasons", F.explode(F.array(reasons))).drop("__v")  # evaluated once, not again in the filters
    return out.where(F.size("reasons") == 0).drop("reasons", CORRUPT), out.where(F.size("reasons") > 0)


def confirmed_hazards_supported(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs with a confirmed hazard that its cited events do not show (see ``events.unsupported_confirmations``)."""
    from tracegrain.operators.events import unsupported_confirmations

    text = lambda p: F.try_variant_get("payload", p, "string")
    raw = lambda p: F.to_json(F.try_variant_get("payload", p, "variant"))
    seen = events.select("run_id", text("$.key").alias("key"), "id", F.concat_ws("|", F.col("pid").cast("string"), "actor_kind", "actor_id").alias("actor"), "category",
                         raw("$.expected").alias("expected"), raw("$.observed").alias("observed"))
    hazards = findings.where((F.col("category") == "concurrency_hazard") & (F.col("status") == "confirmed")).withColumn("key", F.try_variant_get("evidence", "$.key", "string"))
    return unsupported_confirmations(hazards, seen).select("run_id").distinct()


def overhead_report(runs: DataFrame, thresholds: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Median cost of each (size, mode) against the baseline mode, its budget and verdict.

    ``runs``: size, mode, exit_code, wall_s, peak_rss_bytes, records, checksum. ``thresholds``: mode, wall_ratio_max, rss_floor_bytes, rss_ratio.
    Memory that was not reported makes a row incomplete, never a pass; a failed run fails it.
    """
    whole = (F.col("exit_code") == 0) & F.col("records").isNotNull() & F.col("peak_rss_bytes").isNotNull()
    per = runs.groupBy("size", "mode").agg(
        F.median("wall_s").alias("wall_s"), F.median("peak_rss_bytes").alias("__rss"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("__whole"),
        F.max((F.col("exit_code") != 0).cast("int")).alias("__failed"), F.min("checksum").alias("__c0"), F.max("checksum").alias("__c1"),
        F.bool_and(F.col("records") == F.col("size")).alias("__full"))
    base = per.where(F.col("mode") == baseline).select("size", F.col("wall_s").alias("__bw"), F.col("__rss").alias("__br"), F.col("__whole").alias("__bwhole"), F.col("__c0").alias("__bc"),
                                                       F.col("__failed").alias("__bfailed"))
    r = per.join(base, "size").join(thresholds, "mode", "left")
    complete = F.col("__whole") & F.col("__bwhole")
    rss = F.when(complete, F.col("__rss"))
    budget = F.when(complete & F.col("wall_ratio_max").isNotNull(), F.col("__br") + F.greatest(F.col("rss_floor_bytes"), F.col("rss_ratio") * F.col("__br")))
    same = complete & F.coalesce(F.col("__full") & (F.col("__c0") == F.col("__bc")) & (F.col("__c1") == F.col("__bc")), F.lit(False))
    wall_pass = complete & (F.col("wall_ratio_max").isNull() | (F.col("wall_s") / F.col("__bw") <= F.col("wall_ratio_max")))
    rss_pass = complete & (budget.isNull() | (rss <= budget))
    failed = (F.col("__failed") == 1) | (F.col("__bfailed") == 1)
    return r.select("size", "mode", F.col("wall_s").alias("median_wall_s"), (F.col("wall_s") / F.col("__bw")).alias("wall_ratio"), rss.alias("median_peak_rss_bytes"),
                    F.when(complete, F.col("__rss") / F.col("__br")).alias("rss_ratio"), budget.alias("rss_budget_bytes"), same.alias("identical_result"),
                    wall_pass.alias("wall_pass"), rss_pass.alias("rss_pass"),
                    F.when(same & wall_pass & rss_pass, "pass").when(complete | failed, "fail").otherwise("incomplete").alias("status"))


def criteria(cases: DataFrame, selectors: dict[str, Sequence[str]], limited: Sequence[str] = ()) -> DataFrame:
    """Status of each criterion from the cases its selectors name.

    ``cases``: id, status (passed, failed, skipped, unsupported). ``selectors``: criterion to the texts a case's id may contain, a fixed
    configuration; ``limited``: criteria that can pass only in part.
    """
    named = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a | b, [F.col("id").contains(t) for t in texts], F.lit(False)), F.lit(name)) for name, texts in selectors.items()]))
    counts = cases.select("status", F.explode(named).alias("criterion")).groupBy("criterion").agg(
        F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("skipped", "unsupported")).alias("incomplete"))
    every = cases.sparkSession.createDataFrame([(n, n in limited) for n in selectors], "criterion string, limited boolean")
    out = every.join(counts, "criterion", "left").na.fill(0, ["passed", "failed", "incomplete"])
    status = (F.when(F.col("passed") + F.col("failed") + F.col("incomplete") == 0, "unsupported").when(F.col("failed") > 0, "fail")
              .when(F.col("incomplete") > 0, F.when(F.col("passed") > 0, "partial").otherwise("unsupported")).when(F.col("limited"), "partial").otherwise("pass"))
    return out.withColumn("status", status)


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped", "unsupported")])


def gate(criteria_rows: DataFrame) -> DataFrame:
    """Exit code of a gate: 1 when any criterion failed, 2 when one is incomplete, else 0."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status").isin("partial", "unsupported"), 1).otherwise(0))
    return criteria_rows.agg(F.when(worst == 2, 1).when(worst == 1, 2).otherwise(0).alias("gate"))

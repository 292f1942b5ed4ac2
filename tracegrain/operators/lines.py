"""Per-line and per-function time, shares, top rows and locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracegrain.operators.scan import scan, top_k, top_k_with_rest


def classify_samples(samples: DataFrame, switch_s: float = 0.005, split: bool = True) -> DataFrame:
    """Charge each sample's elapsed time to python, native, system and unsplit time.

    Columns used: run_id, tick, elapsed_s (time since the previous sample), cpu_s (thread CPU in it, null
    without a clock), wait_s (how long the sampler waited for the lock). More than one running thread in a
    tick makes the lock signal ambiguous.
    """
    cpu = F.least(F.greatest(F.col("cpu_s"), F.lit(0.0)), F.col("elapsed_s"))
    running = samples.where(F.col("cpu_s") > 0.2 * F.col("elapsed_s")).groupBy("run_id", "tick").agg(F.count(F.lit(1)).alias("__running"))
    s = samples.join(running, ["run_id", "tick"], "left").withColumn("__cpu", cpu)
    clock = F.col("cpu_s").isNotNull()
    unsplit = F.lit(not split) | (F.coalesce("__running", F.lit(0)) > 1)
    wait, switch = F.col("wait_s"), F.lit(switch_s)
    native = (F.when(~clock | unsplit, F.lit(0.0))
              .when(wait > 2 * switch, F.least(F.col("__cpu"), wait - switch))
              .when(wait < 0.5 * switch, F.col("__cpu")).otherwise(F.lit(0.0)))
    return s.withColumns({
        "native_s": native,
        "python_s": F.when(~clock | unsplit, F.lit(0.0)).otherwise(F.col("__cpu") - native),
        "system_s": F.when(clock, F.col("elapsed_s") - F.col("__cpu")).otherwise(F.lit(0.0)),
        "unsplit_s": F.when(~clock, F.col("elapsed_s")).when(unsplit, F.col("__cpu")).otherwise(F.lit(0.0)),
    }).drop("__running", "__cpu")


def line_totals(samples: DataFrame, measures: Sequence[str], keys: Sequence[str] = ("run_id", "file", "line")) -> DataFrame:
    """Sums of the measures and the sample count per line."""
    return samples.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("samples"))


def with_share(df: DataFrame, value: str, keys: Sequence[str] = ("run_id",), name: str = "share") -> DataFrame:
    """value / group total; a total of zero counts as one. The totals are joined, not windowed: a group of any size stays in as many tasks as it came in."""
    total = F.sum(value)
    totals = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.when(total == 0, F.lit(1)).otherwise(total).alias("__total"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = df.join(totals, same, "left")
    return joined.withColumn(name, F.col(value) / F.col("__total")).select(*df.columns, name)


def function_totals(lines: DataFrame, measures: Sequence[str], maxima: Sequence[str] = (),
                    keys: Sequence[str] = ("run_id", "file", "first_line")) -> DataFrame:
    """Function rows from line rows: sums, and maxima where a sum would not mean anything."""
    return lines.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in measures], *[F.max(m).alias(m) for m in maxima], F.sum("samples").alias("samples"))


def threads(samples: DataFrame, order: Sequence[str]) -> DataFrame:
    """Threads of each run with their last name."""
    return samples.groupBy("run_id", "thread").agg(F.max_by("thread_name", F.struct(*order)).alias("thread_name"))


def line_events(events: DataFrame, order: str, cap: int | None = None) -> DataFrame:
    """Executed-line counts; the first ``cap`` locations (all without one) seen keep a row, the others are summed as dropped."""
    counts = events.groupBy("run_id", "file", "line").agg(F.count(F.lit(1)).alias("line_events"), F.min(order).alias("__first"))
    kept = top_k_with_rest(counts, ["run_id"], [F.col("__first").asc(), F.col("file").asc(), F.col("line").asc()], cap,
                           {"dropped_events": "line_events"})
    return kept.drop("__first", "rank").withColumnRenamed("omitted_rows", "dropped_locations")


def top_both(df: DataFrame, keys: Sequence[str], time: str, memory: str, n: int, ties: Sequence[str]) -> DataFrame:
    """Union of the n largest rows by time and by memory (when above zero)."""
    rest = [F.col(c).asc() for c in ties]
    by_time = top_k(df, keys, [F.col(time).desc(), *rest], n, "time_rank")
    by_memory = top_k(df.where(F.col(memory) > 0), keys, [F.col(memory).desc(), *rest], n, "memory_rank")
    ranks = by_memory.select(*keys, *ties, "memory_rank")
    both = by_time.join(ranks, [*keys, *ties], "left")
    only_memory = by_memory.join(by_time.select(*keys, *ties), [*keys, *ties], "left_anti").withColumn("time_rank", F.lit(None).cast("int"))
    return both.unionByName(only_memory)


def top_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """The report's first table: lines by time, then file and line."""
    return top_k(lines.where(F.col("time_s") > 0), ["run_id"], [F.col("time_s").desc(), F.col("file").asc(), F.col("line").asc()], n)


def locations(*tables: DataFrame) -> DataFrame:
    """Every (run, file, line) any of the tables measured."""
    out = None
    for t in tables:
        part = t.select("run_id", "file", "line").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def sampled_spans(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """[first, last] line of every sampled function; the last sampled line stands in for an unknown end."""
    seen = lines.where(F.col("func_line").isNotNull() & (F.col("samples") > 0)).groupBy(
        "run_id", "file", F.col("func_line").alias("first_line")).agg(F.greatest(F.max("line"), F.first("func_line")).alias("__last"))
    named = functions.select("run_id", "file", "first_line", "name", "end_line")
    spans = seen.join(named, ["run_id", "file", "first_line"], "left").where(F.coalesce("name", F.lit("")) != "<module>")
    return spans.select("run_id", "file", "first_line", F.coalesce("end_line", "__last").alias("last_line"))


def inside_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str] = ("run_id", "file"), line: str = "line",
                 flag: str = "inside") -> DataFrame:
    """Flag points lying in any span, by one ordered sweep over starts and points (no range join).

    A point is covered exactly when the largest end among spans starting at or before it reaches it.
    """
    cols = points.columns
    starts = spans.select(*keys, F.col("first_line").cast("long").alias("__at"), F.lit(0).alias("__kind"),
                          F.col("last_line").cast("long").alias("__end"), F.lit(None).cast("long").alias("__id"),
                          *[F.lit(None).cast(t).alias(f"__p_{c}") for c, t in points.dtypes]).distinct()
    rows = points.withColumn("__id", F.xxhash64(*[F.col(c) for c, t in points.dtypes if "map<" not in t])).select(
        *keys, F.col(line).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__end"), "__id",
        *[F.col(c).alias(f"__p_{c}") for c in cols])
    swept = scan(starts.unionByName(rows), keys, ["__at", "__kind", "__id"], run_max={"__reach": F.col("__end")})
    covered = F.coalesce(F.col("__reach") >= F.col("__at"), F.lit(False))
    return swept.where(F.col("__kind") == 1).select(*[F.col(f"__p_{c}").alias(c) for c in cols], covered.alias(flag))


def innermost_scope(points: DataFrame, scopes: DataFrame, keys: Sequence[str] = ("file",), width: int = 64,
                    skip_inline: Column | None = None) -> DataFrame:
    """Name and first line of the latest-starting scope that contains each point.

    Both sides meet on blocks of ``width`` lines, after points are reduced to distinct lines, so a block
    never holds more than ``width`` lines however often a line occurs.
    """
    keys = list(keys)
    lines = points.select(*keys, "line", *([skip_inline.alias("__skip")] if skip_inline is not None else [])).distinct()
    extra = ["__skip"] if skip_inline is not None else []
    blocks = scopes.withColumn("__block", F.explode(F.sequence(
        F.floor(F.col("first_line") / width).cast("long"), F.floor(F.col("last_line") / width).cast("long"))))
    met = lines.withColumn("__block", F.floor(F.col("line") / width).cast("long")).join(blocks, [*keys, "__block"])
    held = met.where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    if skip_inline is not None:
        held = held.where(~(F.col("__skip") & F.col("inline") & (F.col("first_line") == F.col("line"))))
    best = held.groupBy(*keys, "line", *extra).agg(
        F.max_by(F.struct("name", "first_line"), F.struct("first_line", "position")).alias("__best"))
    rows = points.withColumn("__skip", skip_inline) if skip_inline is not None else points
    out = rows.join(best, [*keys, "line", *extra], "left")
    return out.withColumns({"scope_name": F.coalesce(F.col("__best")["name"], F.lit("")),
                            "scope_line": F.coalesce(F.col("__best")["first_line"].cast("long"), F.col("line").cast("long"))}
                           ).drop("__best", "__skip")


def scope_labels(points: DataFrame, scopes: DataFrame, keys: Sequence[str] = ("file",), width: int = 64) -> DataFrame:
    """The chain of scopes around each point, outermost first: ``Repo.lookup()``; null at module level."""
    keys = list(keys)
    lines = points.select(*keys, "line").distinct()
    blocks = scopes.withColumn("__block", F.explode(F.sequence(
        F.floor(F.col("first_line") / width).cast("long"), F.floor(F.col("last_line") / width).cast("long"))))
    held = (lines.withColumn("__block", F.floor(F.col("line") / width).cast("long")).join(blocks, [*keys, "__block"])
            .where(F.col("line").between(F.col("first_line"), F.col("last_line"))))
    # The list is one entry per nesting level.
    chain = held.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(F.struct("first_line", "position", "name", "is_function"))).alias("__in"))
    label = F.concat(F.array_join(F.transform("__in", lambda s: s["name"]), "."),
                     F.when(F.element_at("__in", -1)["is_function"], F.lit("()")).otherwise(F.lit("")))
    return points.join(chain, [*keys, "line"], "left").withColumn("scope", label).drop("__in")

"""Numbers: rounding, noise margins, verdicts, heat, retention growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

MIB_IN_MB = 1.048576

# Severity numbers used by editors.
SEVERITY = {"error": 0, "warning": 1, "information": 2, "hint": 3}


def half_up(x: Column, digits: int = 3) -> Column:
    """Round half towards +infinity, the rounding of the summary documents."""
    scale = 10 ** digits
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)


def net_cents(cents: Column, quantity: Column, bps: Column) -> Column:
    """cents * quantity less basis points; integer division truncates, inputs are never negative."""
    return F.call_function("div", cents * quantity * (F.lit(10000) - bps), F.lit(10000))


def has_exit_snapshot(run: Column) -> Column:
    """Whether the last snapshot covers the whole program at its end."""
    whole = (run["memory_mode"] == "precise") & run["memory_tracing_lost_s"].isNull() & run["trace_function"].isNull()
    return F.coalesce(whole & F.coalesce(run["memory_snapshot_at_exit"], run["memory_attribution"].isNull()), F.lit(False))


def process_residual_mb(run: Column) -> Column:
    """Positive unexplained process memory; null when it cannot be told."""
    usable = ((run["memory_mode"] == "precise") & run["trace_function"].isNull()
              & run["memory_tracing_lost_s"].isNull() & (run["native_untraced_mb"] > 0))
    return F.when(usable, run["native_untraced_mb"])


def native_estimate(rss_max: Column, rss_start: Column, peak_traced: Column, bookkeeping: Column) -> Column:
    """Process bytes beyond traced peak and bookkeeping; null within twice the bookkeeping."""
    rest = rss_max - peak_traced - bookkeeping - F.coalesce(rss_start, F.lit(0))
    return F.when(rest > 2 * bookkeeping, rest)


def time_noise(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Run-to-run margin of two sampled times, from their sample counts."""
    def spread(t: Column, n: Column) -> Column:
        return F.when(t > 0, t * t / F.greatest(F.lit(1), n)).otherwise(F.lit(0.0))
    return F.greatest(2 * F.sqrt(spread(a, na) + spread(b, nb)), F.lit(0.1) * F.greatest(a, b))


def memory_noise(a: Column, b: Column, rss: bool = False) -> Column:
    """Run-to-run margin of two memory values in MB."""
    floor, ratio = (10.0, 0.2) if rss else (1.0, 0.15)
    return F.greatest(F.lit(floor), F.lit(ratio) * F.greatest(a, b))


def change(base: Column, cur: Column, noise: Column) -> Column:
    """struct(base, cur, delta, noise, verdict); a null side means new or gone, never zero."""
    diff = F.coalesce(cur, F.lit(0.0)) - F.coalesce(base, F.lit(0.0))
    verdict = (F.when(base.isNull(), F.lit("new")).when(cur.isNull(), F.lit("gone"))
               .when(F.abs(diff) <= noise, F.lit("same")).when(diff > 0, F.lit("worse")).otherwise(F.lit("better")))
    return F.struct(base.alias("base"), cur.alias("cur"), diff.alias("delta"), noise.alias("noise"), verdict.alias("verdict"))


def heat(samples: Column, share: Column, memory_mb: Column, growing: Column, *, hot_share: float, hot_mb: float,
         inside_sampled: Column | None = None, line_events: Column | None = None, sampled_run: Column | None = None) -> Column:
    """hot, cold or unknown for one measured line (nulls: the line was not measured)."""
    inside = inside_sampled if inside_sampled is not None else F.lit(False)
    events = F.coalesce(line_events, F.lit(0)) > 0 if line_events is not None else F.lit(False)
    sampled = F.coalesce(sampled_run, F.lit(True)) if sampled_run is not None else F.lit(True)
    memory = F.coalesce(memory_mb, F.lit(0.0))
    unmeasured = samples.isNull() | ((samples == 0) & (memory == 0))
    return (F.when(unmeasured, F.when(F.coalesce(inside, F.lit(False)) | events | ~sampled, F.lit("unknown")).otherwise(F.lit("cold")))
            .when((share >= hot_share) | (memory >= hot_mb) | F.coalesce(growing, F.lit(False)), F.lit("hot"))
            .otherwise(F.lit("unknown")))


def adjust_severity(severity: Column, heat_of_line: Column) -> Column:
    """Hot raises one step, cold lowers non-errors to a hint."""
    return (F.when(heat_of_line == "hot", F.greatest(F.lit(0), severity - 1))
            .when((heat_of_line == "cold") & (severity != SEVERITY["error"]), F.lit(SEVERITY["hint"]))
            .otherwise(severity))


@dataclass(frozen=True)
class GrowthRule:
    """When a series of held amounts counts as still growing."""

    points: int          # trailing points looked at
    recent: int          # a meaningful rise must lie in this many last changes
    least: float         # smallest amount held at the end
    tolerance: float     # absolute part of a change that does not count
    growth: float        # absolute part of the growth needed over the points
    minimum: int = 4     # points needed in total
    rises: int = 3       # meaningful rises needed


# The recorder's rule works on bytes, the reader's on MB; a line is growing only under both.
RECORDER_RULE = GrowthRule(points=6, recent=3, least=float(1 << 20), tolerance=1024.0, growth=float(64 << 10))
READER_RULE = GrowthRule(points=5, recent=2, least=MIB_IN_MB, tolerance=0.001024, growth=0.065536)


def meaningful_rises(series: Column, rule: GrowthRule) -> Column:
    """Count of rises beyond tolerance between neighbours of a short array."""
    return F.size(_changes(series, rule, "up"))


def _changes(series: Column, rule: GrowthRule, which: str) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(series) - 1),
                        lambda i: F.struct(i.alias("i"), F.get(series, i - 1).alias("a"), F.get(series, i).alias("b")))
    def margin(p: Column) -> Column:
        return F.greatest(F.lit(rule.tolerance), p["a"] * 0.001)
    if which == "up":
        return F.filter(pairs, lambda p: p["b"] - p["a"] > margin(p))
    return F.filter(pairs, lambda p: p["b"] - p["a"] < -margin(p))


def growing(series: Column, rule: GrowthRule = READER_RULE) -> Column:
    """Sustained recent growth of an ordered array of amounts (a plateau or a decline ends it)."""
    last = F.when(F.size(series) > rule.points, F.slice(series, F.size(series) - rule.points + 1, rule.points)).otherwise(series)
    n = F.size(last)
    end, start = F.get(last, n - 1), F.get(last, F.lit(0))
    ups, downs = _changes(last, rule, "up"), _changes(last, rule, "down")
    holds = ((end >= rule.least) & (F.size(ups) >= rule.rises) & (F.size(downs) == 0)
             & F.exists(ups, lambda p: p["i"] >= n - rule.recent)
             & (end - start >= F.greatest(F.lit(rule.growth), end * 0.01)))
    return F.when(F.size(series) < rule.minimum, F.lit(False)).otherwise(F.coalesce(holds, F.lit(False)))

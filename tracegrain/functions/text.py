"""Sentences and labels built from measurements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value; only an exact tie rounds up (format_string rounds the shortest decimal instead)."""
    scaled = x * float(2 ** (digits + 1))
    tie = (scaled == F.floor(scaled)) & (F.floor(scaled) % 2 == 1)
    return F.when(tie, F.format_string(f"%.{digits}f", x)).otherwise(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")))


def mb_text(x: Column) -> Column:
    return F.concat(F.when(x >= 100, fixed(x, 0)).otherwise(fixed(x, 1)), F.lit(" MB"))


def seconds_text(x: Column) -> Column:
    return F.concat(F.when(x >= 10, fixed(x, 1)).otherwise(fixed(x, 2)), F.lit(" s"))


def percent_text(x: Column) -> Column:
    return F.concat(F.when(x >= 0.1, fixed(x * 100, 0)).otherwise(fixed(x * 100, 1)), F.lit("%"))


def time_split(total: Column, python_s: Column, native_s: Column, system_s: Column) -> Column:
    """Parts of at least 5%, as text; empty when no time was measured."""
    def part(name: str, value: Column) -> Column:
        return F.when(value / total >= 0.05, F.concat(F.lit(name + " "), percent_text(value / total)))
    parts = F.array_compact(F.array(part("py", python_s), part("native", native_s), part("sys", system_s)))
    return F.when(total > 0, F.array_join(parts, " · ")).otherwise(F.lit(""))


def line_label(time_s: Column, share: Column, split: Column, precise: Column, peak_mb: Column,
               assigns: Column, growing: Column, end_mb: Column, holders: Column) -> Column:
    """The end-of-line label of a measured line."""
    skew = F.when(precise, F.lit(" ~")).otherwise(F.lit(""))
    timing = F.when(time_s > 0, F.concat(F.lit("⏱ "), seconds_text(time_s), skew, F.lit(" "), percent_text(share),
                                         F.when(split != "", F.concat(F.lit(" ("), split, F.lit(")"))).otherwise(F.lit(""))))
    into = F.when(F.size(F.coalesce(assigns, F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit(" → "), F.array_join(assigns, ", "))).otherwise(F.lit(""))
    held = F.when(precise & (peak_mb >= 1), F.concat(F.lit("▲ held "), mb_text(peak_mb), into))
    by = F.when(F.size(F.coalesce(holders, F.array().cast("array<string>"))) > 0,
                F.concat(F.lit(" by "), F.array_join(holders, ", "))).otherwise(F.lit(""))
    grows = F.when(growing, F.concat(F.lit("⚠ growing: "), mb_text(F.coalesce(end_mb, F.lit(0.0))), F.lit(" held"), by))
    return F.array_join(F.array_compact(F.array(timing, held, grows)), "   ")


def function_label(name: Column, time_s: Column, split: Column, held_mb: Column) -> Column:
    """Totals of a function, as text."""
    return F.concat_ws(" ", F.concat(F.lit("Σ "), name, F.lit("(): "), seconds_text(time_s)),
                       F.when(split != "", F.concat(F.lit("("), split, F.lit(")"))),
                       F.when(held_mb >= 1, F.concat(F.lit("· "), mb_text(held_mb), F.lit(" held at peak"))))


def evidence(heat_of_line: Column, share: Column, memory_mb: Column, growing: Column) -> Column:
    """What a run says about a statically found line."""
    bits = F.array_compact(F.array(
        F.concat(F.lit("time "), percent_text(share)),
        F.when(memory_mb >= 1, F.concat(F.lit("memory "), mb_text(memory_mb))),
        F.when(growing, F.lit("still growing"))))
    return (F.when((heat_of_line == "hot") & share.isNotNull(), F.concat(F.lit("hot: "), F.array_join(bits, ", ")))
            .when(heat_of_line == "cold", F.lit("cold: the sampler never saw this line, which may mean it never ran"))
            .otherwise(F.lit("")))


def subject_prefix(scope: Column, subject: Column) -> Column:
    """``Repo.lookup() › `rows` — `` with either part optional."""
    parts = F.array_compact(F.array(scope, F.concat(F.lit("`"), subject, F.lit("`"))))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " › "), F.lit(" — "))).otherwise(F.lit(""))


def leak_message(scope: Column, subject: Column, holders: Column, leak_runs: Column, end_mb: Column) -> Column:
    """One sentence about a line whose retained memory kept growing. ``holders``: array of (holder, type, items)."""
    named = F.transform(holders, lambda h: F.concat(F.lit("`"), h["holder"], F.lit("` ("), h["type"], F.lit(", "), h["items"].cast("string"),
                                                   F.when(h["items"] == 1, F.lit(" item)")).otherwise(F.lit(" items)"))))
    any_holder = F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0
    held = F.when(any_holder, F.concat(F.lit("Kept by "), F.array_join(named, ", "), F.lit(": give it a limit."))).otherwise(
        F.lit("Nobody is known to keep it: look for a module-level container that is appended to."))
    return F.concat(subject_prefix(scope, subject), F.lit("leak? "), mb_text(F.coalesce(end_mb, F.lit(0.0))), F.lit(" left after "), leak_runs.cast("string"),
                    F.lit(" rises in a row. "), held)


def render_message(sized: Column, neutral: Column, facts: Column) -> Column:
    """Fill ``{name}`` placeholders; the sized text only when every one of its facts is known."""
    names = F.regexp_extract_all(sized, F.lit(r"\{([a-z0-9_]+)\}"), F.lit(1))
    known = sized.isNotNull() & F.forall(names, lambda n: F.array_contains(F.map_keys(facts), n))
    template = F.when(F.coalesce(known, F.lit(False)), sized).otherwise(neutral)
    wanted = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([a-z0-9_]+)\}"), F.lit(1)))
    return F.aggregate(
        F.filter(wanted, lambda n: F.array_contains(F.map_keys(facts), n)), template,
        lambda text, n: F.replace(text, F.concat(F.lit("{"), n, F.lit("}")), F.try_element_at(facts, n)))

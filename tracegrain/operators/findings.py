"""Static findings against measurements: freshness, heat, adjusted severity; path remapping by table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.functions.measures import SEVERITY, adjust_severity, heat
from tracegrain.functions.paths import norm_path
from tracegrain.functions.text import evidence


def freshness(current: DataFrame, profiled: DataFrame, measured: DataFrame) -> DataFrame:
    """Whether each current file is what a run measured: fresh, stale, or absent from the run.

    ``current``: run_id, file, sha1 (null when the text could not be read: unverified); ``profiled``: run_id, file, sha1 from the
    run; ``measured``: run_id, file of the measured files.
    """
    files = measured.select("run_id", "file").distinct().withColumn("__in", F.lit(True))
    then = profiled.select("run_id", "file", F.col("sha1").alias("__then"))
    out = current.join(files, ["run_id", "file"], "left").join(then, ["run_id", "file"], "left")
    state = (F.when(F.col("__in").isNull(), "absent").when(F.col("sha1").isNull(), "unverified")
             .when(F.col("sha1") == F.col("__then"), "fresh").otherwise("stale"))
    return out.withColumn("freshness", state).drop("__in", "__then")


def adjusted(findings: DataFrame, lines: DataFrame, fresh: DataFrame, hot_share: float, hot_mb: float, spans: DataFrame | None = None) -> DataFrame:
    """Findings with the heat of their line and a severity raised on hot and lowered on cold lines; stale files stay as they are.

    ``lines``: run_id, file, line, samples, share, memory_mb, growing. With ``spans`` an unsampled line inside a sampled function is
    unknown, not cold.
    """
    from tracegrain.operators.lines import inside_spans

    f = findings
    if spans is not None:
        at = inside_spans(findings.select("run_id", "file", "line").distinct(), spans)
        f = f.join(at, ["run_id", "file", "line"], "left")
    else:
        f = f.withColumn("inside", F.lit(False))
    f = f.join(lines.select("run_id", "file", "line", "samples", "share", "memory_mb", "growing"), ["run_id", "file", "line"], "left")
    f = f.join(fresh.select("run_id", "file", "freshness"), ["run_id", "file"], "left")
    h = heat(F.col("samples"), F.col("share"), F.col("memory_mb"), F.col("growing"), hot_share=hot_share, hot_mb=hot_mb, inside_sampled=F.col("inside"))
    is_fresh = F.coalesce(F.col("freshness") == "fresh", F.lit(False))
    f = f.withColumn("heat", F.when(is_fresh, h))
    levels = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    names = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    level = F.try_element_at(levels, F.col("severity"))
    shown = F.try_element_at(names, F.when(is_fresh, adjust_severity(level, F.col("heat"))).otherwise(level))
    note = F.when(is_fresh, evidence(F.col("heat"), F.col("share"), F.coalesce("memory_mb", F.lit(0.0)), F.coalesce("growing", F.lit(False)))).otherwise(F.lit(""))
    return f.withColumns({"adjusted": shown, "measured": F.coalesce("heat", F.lit("source changed")), "evidence": note}).drop("inside")


def remap_by_table(paths: DataFrame, mappings: DataFrame, column: str = "path", strict: bool = False) -> DataFrame:
    """Rebase paths by the longest matching prefix of a mapping table (source, target).

    Each distinct path is joined on its own prefixes, so the match is an equality join however many mappings there are.
    """
    slashed = norm_path(F.col(column))
    distinct = paths.select(F.col(column).alias("__p")).distinct().withColumn("__parts", F.split(norm_path(F.col("__p")), "/"))
    prefixes = distinct.select("__p", F.explode(F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda i: F.array_join(F.slice("__parts", F.lit(1), i), "/"))).alias("source"))
    rules = mappings.select(F.regexp_replace(norm_path(F.col("source")), "/+$", "").alias("source"), F.regexp_replace("target", "/+$", "").alias("target"))
    best = prefixes.join(rules, "source").groupBy("__p").agg(F.max_by(F.struct("source", "target"), F.struct(F.length("source"), F.col("target"))).alias("__m"))
    out = paths.join(best.withColumnRenamed("__p", column), column, "left")
    moved = F.concat(F.col("__m")["target"], F.substr(slashed, F.length(F.col("__m")["source"]) + 1))
    kept: Column = F.raise_error(F.concat(F.lit("no mapping covers "), F.col(column))).cast("string") if strict else F.col(column)
    return out.withColumn("mapped", F.when(F.col("__m").isNotNull(), moved).otherwise(kept)).drop("__m")


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows in only one of two finding sets, duplicates counted: missing from ``actual`` or unexpected in it."""
    actual = actual.select(*expected.columns)
    return expected.exceptAll(actual).withColumn("problem", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("problem", F.lit("unexpected")))

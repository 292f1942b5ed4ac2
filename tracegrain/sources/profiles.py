"""Run documents to tables keyed by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegrain.schemas import PROFILE
from tracegrain.session import cut_lineage

CORRUPT = "_corrupt"


def pack_profiles(documents: DataFrame, folder: str) -> None:
    """The documents of a column ``raw``, many to a file, each with a path of its own below the folder: files then grow with bytes, not with runs."""
    name = F.concat(F.lit(folder.rstrip("/") + "/"), F.monotonically_increasing_id().cast("string"), F.lit(".json"))
    documents.select(name.alias("path"), "raw").write.parquet(folder)


def read_profiles(spark: SparkSession, paths: str | list[str], packed: bool = False) -> DataFrame:
    """One row per run document, version 2 or 3, with ``run_id`` from its path and the raw text kept for checks. A document is a file, or a row
    that ``pack_profiles`` wrote."""
    if packed:
        texts = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select("path", "raw")
    else:
        texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return parse_profiles(texts)


def parse_profiles(texts: DataFrame) -> DataFrame:
    """Parse documents given as (path, raw)."""
    doc = F.from_json("raw", PROFILE + f", {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    # The one-element explode keeps the optimizer from repeating the parse in every expression that reads a field.
    return texts.withColumn("__d", F.explode(F.array(doc))).select(F.sha2("path", 256).alias("run_id"), "path", "raw", "__d.*")


_RUN_COLUMNS = (
    "schema", "script", "python", "gil_split", "wall_s", "cpu_s", "memory_mode", "samples", "interval_s", "snapshots", "rss_kind", "rss_start_mb",
    "rss_end_mb", "peak_traced_mb", "rss_peak_mb", "native_untraced_mb", "unattributed_peak_mb", "frames", "memory_tracing_lost_s", "sampler_error",
    "stack_sampling", "tracemalloc_peak_mb", "trace_function", "run", "process_id", "memory_attribution", "memory_snapshot_at_exit", "native_memory",
    "monitoring", "memory_guard", "allocation_backend", "baseline")


def runs(profiles: DataFrame) -> DataFrame:
    out = profiles.select("run_id", "path", *_RUN_COLUMNS,
                          F.col("diagnostics").isNotNull().alias("has_diagnostics"), F.col("memory_stacks").isNotNull().alias("has_memory_stacks"),
                          F.col("memory_stacks.depth").alias("memory_stack_depth"),
                          F.col("memory_stacks.exit.total_bytes").alias("exit_total_bytes"), F.col("memory_stacks.exit.t").alias("exit_t"),
                          F.col("memory_stacks.peak").isNotNull().alias("has_peak_table"), F.col("gc.supported").alias("gc_supported"))
    return out.withColumn("started_at", F.try_to_timestamp(F.col("run.started_at")))


def _entries(profiles: DataFrame, column: str, key: str) -> DataFrame:
    by_file = profiles.select("run_id", F.explode(column).alias("file", "__entries"))
    return by_file.select("run_id", "file", F.explode("__entries").alias("__k", "__e")).select(
        "run_id", "file", F.col("__k").cast("int").alias(key), "__e.*")


def lines(profiles: DataFrame) -> DataFrame:
    return _entries(profiles, "files", "line")


def functions(profiles: DataFrame) -> DataFrame:
    return _entries(profiles, "functions", "first_line")


def file_hashes(profiles: DataFrame) -> DataFrame:
    return profiles.select("run_id", F.explode("file_hashes").alias("file", "sha1"))


def _resolve(ids: Column, frames: Column) -> Column:
    return F.transform(ids, lambda i: F.get(frames, i))


def stack_samples(profiles: DataFrame) -> DataFrame:
    s = profiles.where(F.col("stacks").isNotNull()).select("run_id", F.col("stacks.frames").alias("__f"), F.posexplode("stacks.samples").alias("i", "s"))
    return s.select("run_id", "i", F.col("s.thread").alias("thread"), F.col("s.thread_name").alias("thread_name"),
                    _resolve(F.col("s.frames"), F.col("__f")).alias("path"), F.col("s.python_s").alias("python_s"), F.col("s.native_s").alias("native_s"),
                    F.col("s.system_s").alias("system_s"), F.col("s.unsplit_s").alias("unsplit_s"), F.col("s.samples").alias("samples"))


def memory_stacks(profiles: DataFrame) -> DataFrame:
    """Rows (run_id, which, t, path, bytes, truncated) of the peak and exit tables."""
    out = None
    for which in ("peak", "exit"):
        t = profiles.where(F.col(f"memory_stacks.{which}").isNotNull()).select(
            "run_id", F.lit(which).alias("which"), F.col(f"memory_stacks.{which}.t").alias("t"), F.col(f"memory_stacks.{which}.other_bytes").alias("other_bytes"),
            F.col("memory_stacks.frames").alias("__f"), F.explode(f"memory_stacks.{which}.stacks").alias("s"))
        t = t.select("run_id", "which", "t", "other_bytes", _resolve(F.col("s.frames"), F.col("__f")).alias("path"),
                     F.col("s.bytes").alias("bytes"), F.col("s.truncated").alias("truncated"))
        out = t if out is None else out.unionByName(t)
    return out


def timeline(profiles: DataFrame) -> DataFrame:
    """Rows (run_id, i, t, traced_mb, rss_mb, path); path is the main thread's user frames at the point.

    Without stacks or with unequal lengths every path is empty. The format caps a timeline at 10,000 points.
    """
    pts = profiles.where(F.col("timeline").isNotNull()).select(
        "run_id", F.col("stacks.samples").alias("__s"), F.col("stacks.frames").alias("__f"), "timeline_stacks", F.posexplode("timeline").alias("i", "p"))
    ids = F.get("__s", F.get("timeline_stacks", F.col("i")))["frames"]
    path = F.filter(_resolve(F.coalesce(ids, F.array().cast("array<int>")), F.col("__f")), lambda f: f["user"])
    return pts.select("run_id", "i", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("traced_mb"), F.get("p", F.lit(2)).alias("rss_mb"),
                      F.coalesce(path, F.expr("cast(array() as array<struct<file:string,line:int,name:string,first_line:int,user:boolean>>)")).alias("path"))


def observations(profiles: DataFrame) -> DataFrame:
    return profiles.select("run_id", F.posexplode("memory_observations").alias("i", "o")).select("run_id", "i", "o.*")


def retention_points(profiles: DataFrame) -> DataFrame:
    l = lines(profiles).select("run_id", "file", "line", F.explode("retention.points").alias("p"))
    return l.select("run_id", "file", "line", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("mb"))


def held_by(profiles: DataFrame) -> DataFrame:
    return lines(profiles).select("run_id", "file", "line", F.explode("held_by").alias("h")).select("run_id", "file", "line", "h.*")


def largest_objects(profiles: DataFrame) -> DataFrame:
    return profiles.select("run_id", F.col("largest_objects.complete").alias("complete"), F.explode("largest_objects.objects").alias("o")).select(
        "run_id", "complete", "o.*")


def gc_events(profiles: DataFrame) -> DataFrame:
    return profiles.select("run_id", F.explode("gc.events").alias("e")).select("run_id", "e.*")


def diag_events(profiles: DataFrame) -> DataFrame:
    return profiles.select("run_id", F.posexplode("diagnostics.events").alias("position", "e")).select("run_id", "position", "e.*").withColumn(
        "payload", F.try_parse_json("payload"))


def diag_findings(profiles: DataFrame) -> DataFrame:
    """Runtime findings with their evidence as VARIANT and the cited event ids as strings."""
    f = profiles.select("run_id", F.explode("diagnostics.findings").alias("f")).select("run_id", "f.*")
    ids = F.transform(F.from_json(F.get_json_object("evidence", "$.event_ids"), "array<string>"), lambda x: x)
    return f.withColumn("event_ids", ids).withColumn("evidence", F.try_parse_json("evidence"))


def alloc_sites(profiles: DataFrame) -> DataFrame:
    files = profiles.select("run_id", F.explode("allocation_backend.files").alias("f"))
    return files.select("run_id", F.posexplode("f.sites").alias("position", "s")).select("run_id", "position", "s.*")


TABLES = {
    "runs": runs, "lines": lines, "functions": functions, "sources": file_hashes, "stack_samples": stack_samples, "memory_stacks": memory_stacks,
    "timeline": timeline, "observations": observations, "retention_points": retention_points, "held_by": held_by, "largest_objects": largest_objects,
    "gc_events": gc_events, "diag_events": diag_events, "diag_findings": diag_findings, "alloc_sites": alloc_sites}


def remap_profiles(profiles: DataFrame, mappings: list[tuple[str, str]]) -> DataFrame:
    """Rebase the paths of a document by configured prefixes; commands and arguments stay as captured."""
    from tracegrain.functions.paths import remap_path

    def m(c: Column) -> Column:
        return remap_path(c, mappings)

    def keys(c: str) -> Column:
        return F.transform_keys(c, lambda k, _: m(k))

    frame = lambda f: f.withField("file", m(f["file"]))
    out = profiles.withColumns({"script": m(F.col("script")), "files": keys("files"), "functions": keys("functions"), "file_hashes": keys("file_hashes")})
    out = out.withColumn("stacks", F.when(F.col("stacks").isNotNull(), F.col("stacks").withField("frames", F.transform("stacks.frames", frame))))
    return out.withColumn("memory_stacks", F.when(F.col("memory_stacks").isNotNull(), F.col("memory_stacks").withField(
        "frames", F.transform("memory_stacks.frames", frame))))


def write_tables(profiles: DataFrame, folder: str) -> None:
    """All tables as Parquet below ``folder``, partitioned by the day a run started.

    A day is written as a whole: writing the same runs again replaces them instead of doubling them.
    """
    profiles = cut_lineage(profiles)  # parsed once, read by every table
    day = profiles.select("run_id", F.coalesce(F.to_date(F.try_to_timestamp(F.col("run.started_at"))), F.lit("1970-01-01").cast("date")).alias("run_date"))
    for name, build in TABLES.items():
        df = build(profiles)
        if name == "runs":
            df = df.drop("allocation_backend")
        df.join(day, "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{folder}/{name}")

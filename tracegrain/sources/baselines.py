"""Named baselines: one partition per name, overwritten as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NAME_RULE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"


def valid_baseline_name(name):
    """Letters, digits, dot, dash and underscore; starts with a letter or digit, no trailing dot."""
    trimmed = F.trim(name)
    return trimmed.rlike(NAME_RULE) & ~trimmed.endswith(".")


def save_baseline(profiles: DataFrame, folder: str, name: str, saved_at: str, git_commit: str | None = None, git_dirty: bool | None = None) -> None:
    """Store the run documents under a name, replacing what that name held."""
    spark = profiles.sparkSession
    if not spark.range(1).select(valid_baseline_name(F.lit(name)).alias("ok")).first()["ok"]:
        raise ValueError(f"not a baseline name: {name!r}")
    rows = profiles.select(
        F.lit(name.strip()).alias("baseline_name"), "run_id", "path", "raw", F.lit(saved_at).cast("timestamp").alias("saved_at"),
        F.lit(git_commit).cast("string").alias("git_commit"), F.lit(git_dirty).cast("boolean").alias("git_dirty"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline_name").parquet(folder)


def list_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Names, newest first."""
    b = spark.read.option("basePath", folder).parquet(folder)
    latest = F.struct("saved_at", "git_commit", "git_dirty")
    out = b.groupBy("baseline_name").agg(F.max(latest).alias("m"), F.count(F.lit(1)).alias("runs"))
    return out.select("baseline_name", "m.*", "runs").orderBy(F.col("saved_at").desc(), "baseline_name")


def load_baseline(spark: SparkSession, folder: str, name: str) -> DataFrame:
    from tracegrain.sources.profiles import parse_profiles

    stored = spark.read.option("basePath", folder).parquet(folder).where(F.col("baseline_name") == name)
    return parse_profiles(stored.select("path", "raw"))

"""Cooperative event traces: JSON Lines, one event per line, many files per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegrain.schemas import ALLOCATION, EVENT



def read_event_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed events with their file of origin; ``payload`` is VARIANT."""
    e = spark.read.schema(EVENT).json(paths).withColumn("trace_path", F.col("_metadata.file_path"))
    return e.withColumn("payload", F.try_parse_json("payload"))


def trace_order() -> list:
    """Time, file, then the event's number in its process: ids are ``pid:number``, and 9 comes before 10."""
    number = F.try_element_at(F.split("id", ":"), F.lit(-1)).try_cast("long")
    return [F.col("timestamp_s"), F.col("trace_path"), F.col("pid"), number, F.col("id")]


def read_allocations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Allocation records: JSON Lines, one record per line; a malformed line fails the read."""
    return spark.read.schema(ALLOCATION).option("mode", "FAILFAST").json(paths)


def merge_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of all files in time order; only traces of one host share a clock."""
    return read_event_traces(spark, paths).orderBy(*trace_order())


def accesses(events: DataFrame, run: str = "trace") -> DataFrame:
    """The shared-access columns the hazard operators read."""
    def text(path: str):
        return F.try_variant_get("payload", path, "string")

    def raw(path: str):
        return F.to_json(F.try_variant_get("payload", path, "variant"))

    locks = F.coalesce(F.from_json(raw("$.synchronization"), "array<struct<lock_id:string,acquisition_id:bigint>>"),
                       F.expr("cast(array() as array<struct<lock_id:string,acquisition_id:bigint>>)"))
    return events.where(F.col("category").isin("shared_read", "shared_write", "shared_outcome")).select(
        F.lit(run).alias("run_id"), "id", F.col("timestamp_s").alias("t"), text("$.key").alias("key"),
        F.concat_ws("|", F.col("pid").cast("string"), "actor_kind", "actor_id").alias("actor"), "category",
        text("$.value.kind").alias("kind"), raw("$.value").alias("value"), locks.alias("synchronization"),
        raw("$.expected").alias("expected"), raw("$.observed").alias("observed"))

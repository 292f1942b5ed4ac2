"""New or changed run documents refresh their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators.checks import validate_profiles
from tracegrain.plans.summary import build_summary
from tracegrain.sources.profiles import parse_profiles


def watch_profiles(spark: SparkSession, folder: str, out: str, checkpoint: str, root: str = "/", pattern: str = "*.json", once: bool = True) -> StreamingQuery:
    """Summaries of arriving documents below ``out/summaries`` and refused ones with their reasons below ``out/rejected``.

    Each batch writes its own folder and replaces it when it is repeated, so a lost executor or driver leaves no duplicates.
    """
    texts = (spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified")))

    def refresh(batch: DataFrame, number: int) -> None:
        good, rejected = validate_profiles(parse_profiles(batch.select("path", "raw")))
        stamp = batch.agg(F.max("modified").cast("string").alias("m")).first()["m"] or ""
        summaries = build_summary(good, root, stamp)
        summaries.select("run_id", "summary.*").write.mode("overwrite").json(f"{out}/summaries/batch={number}")
        rejected.select("run_id", "path", "reasons").write.mode("overwrite").json(f"{out}/rejected/batch={number}")

    writer = texts.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

"""Starting and finishing streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegrain.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state on disk; the stateful processors need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def job_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything available into Parquet files and return them as a table."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    folder = folder or job_folder(spark)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_in_order(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Process everything available of an ordered detector: (its rows, the late rows it left aside). The two are written apart."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    folder = folder or job_folder(spark)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").partitionBy("late")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    marks = ["late", "late_t", "late_seq"]
    return rows.where(~F.col("late")).drop(*marks), rows.where("late")


def read_files_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files below a folder as a stream, oldest first."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """One table file of a folder as a stream, a bounded number of files in a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)

"""Record workload files: JSON Lines, CSV, text logs, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegrain.schemas import CSV_SUMMARY, RAW, RAW_FIELDS


def read_raw(spark: SparkSession, folder: str, files: str = "page-*") -> DataFrame:
    """JSON Lines pages as strings; a malformed line fails the read."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").option("pathGlobFilter", files).json(folder)


def read_raw_strict(spark: SparkSession, folder: str, files: str = "page-*") -> DataFrame:
    """As ``read_raw``, and a field outside the schema also fails the read."""
    lines = spark.read.option("pathGlobFilter", files).text(folder)
    return parse_strict(lines, F.col("value"))


def parse_strict(lines: DataFrame, text: Column) -> DataFrame:
    unknown = F.array_except(F.json_object_keys(text), F.array(*[F.lit(f) for f in RAW_FIELDS]))
    checked = F.when(F.coalesce(F.size(unknown), F.lit(1)) > 0, F.raise_error(
        F.concat(F.lit("unknown fields or malformed record: "), F.coalesce(F.array_join(unknown, ","), text))).cast("string")).otherwise(text)
    return lines.select(F.from_json(checked, RAW, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV_SUMMARY).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The last comma field of every text line, as a number."""
    return log_amounts(spark.read.text(path))


def log_amounts(lines: DataFrame) -> DataFrame:
    return lines.select(F.substring_index("value", ",", -1).cast("long").alias("amount"))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-pruned Parquet read; the reader streams row batches by itself."""
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, folder: str, zstd_level: int = 3, max_records_per_file: int = 1_000_000, row_group_bytes: int = 64 << 20) -> None:
    (df.write.mode("errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", zstd_level)
     .option("parquet.block.size", row_group_bytes).option("maxRecordsPerFile", max_records_per_file).parquet(folder))


def write_sharded_jsonl(df: DataFrame, folder: str, rows_per_file: int) -> None:
    """Gzip JSON Lines shards of at most ``rows_per_file`` rows."""
    df.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).json(folder)

"""Whole files: source text with its hash, and dataset digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracegrain.functions.paths import text_hash
from tracegrain.sources.ranges import PARTITION_BYTES, ByteRangeSource

LEAF = 8 << 20
FAN = 1024
PARTS_A_CORE = 8


def scan_sources(spark: SparkSession, root: str, pattern: str = "*.{py,pyw}") -> DataFrame:
    """(path, text, sha1) of the source files below a folder, Python's unless told otherwise; hidden folders and node_modules are left out."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    below = F.regexp_replace("path", F.lit("^.*?" + root.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    hidden = below.rlike(r"(^|/)(\.[^/]+|node_modules)/")
    return files.where(~hidden).withColumn("sha1", text_hash(F.col("text")))


def file_digest(spark: SparkSession, folder: str, pattern: str = "*", leaf: int = LEAF, fan: int = FAN, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Path, size and tree digest of every file below a folder, of any size.

    A file is read in byte ranges by as many tasks as it takes, ``leaf`` bytes in memory at a time. The digest of a leaf is its SHA-256; ``fan`` neighbours
    become one node, the SHA-256 of their hex digests in order, level by level; a node alone goes up unchanged, so a file of one leaf has its plain SHA-256.
    ``leaf`` and ``fan`` are part of the digest; ``partition_bytes``, how ranges are dealt to tasks, is not:
    tasks read more where there would be over PARTS_A_CORE of them for each core.
    """
    spark.dataSource.register(ByteRangeSource)
    uri = folder if ":" in folder.split("/")[0] else spark.conf.get("spark.hadoop.fs.defaultFS", "file://").rstrip("/") + folder
    nodes = (spark.read.format(ByteRangeSource.name()).option("pattern", pattern).option("leaf", str(leaf)).option("partitionBytes", str(partition_bytes))
             .option("partsWanted", str(PARTS_A_CORE * spark.sparkContext.defaultParallelism)).load(uri))
    children = F.array_sort(F.collect_list(F.struct("node", "sha256")))  # at most ``fan``
    for _ in range(tree_levels(leaf, fan)):
        joined = F.array_join(F.transform(children, lambda c: c["sha256"]), "")
        nodes = nodes.groupBy("path", "bytes", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(
            F.when(F.count(F.lit(1)) == 1, F.first("sha256")).otherwise(F.sha2(joined, 256)).alias("sha256"))
    return nodes.select("path", "bytes", "sha256")


def tree_levels(leaf: int, fan: int) -> int:
    """Levels after which a file of any 64-bit length has one node."""
    levels, covered = 0, leaf
    while covered < 1 << 63:
        levels, covered = levels + 1, covered * fan
    return levels


def row_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free content digest of a table: 60 bits of the MD5 of each row's text, summed.

    A row's text is its columns by name, cast to text and joined by the unit separator, null as ``\\N``: any engine can compute it.
    """
    columns = [F.to_json(c) if isinstance(t, T.MapType) else F.col(f"`{c}`").cast("string") for c, t in sorted(((f.name, f.dataType) for f in df.schema), key=lambda x: x[0])]
    text = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\\N")) for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))

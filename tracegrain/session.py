"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_CHUNK_KEY = "spark.tracegrain.rowsPerChunk"
DEFAULT_ROWS_PER_CHUNK = 1_000_000
PARTS_A_CORE = 2


def build_session(app: str = "tracegrain", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings win where they are given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.maxPlanStringLength", "100000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call-site capture per column costs more than small plans
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def rows_per_chunk(spark: SparkSession) -> int:
    """How many rows of one group a single task may order before the group is split."""
    return int(spark.conf.get(ROWS_PER_CHUNK_KEY, str(DEFAULT_ROWS_PER_CHUNK)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a private one only in local mode, where none may be set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tracegrain-checkpoint-")
    return folder


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, where each costs far more than its bytes say: a small file is read by one task."""
    return df.repartition(PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder, for tables that several parts of an operator read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A wide table that many steps read, as Parquet in the shared folder: a step reads its columns only, and no step repeats the work above it.

    Joins with it are merged. Spark would guess its parts' sizes from the tables that its rows were made of, and send far larger ones through the driver.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).hint("merge")

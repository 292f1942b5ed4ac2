"""A cursor-paged record service as a Spark data source: one input partition per run of pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedRecords(DataSource):
    """Options: records, pageSize, pagesPerTask. Rows carry their page and the record id."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page bigint, id bigint"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.records = int(options["records"])
        self.page_size = int(options.get("pageSize", "1000"))
        self.per_task = int(options.get("pagesPerTask", "100"))

    def partitions(self) -> list[InputPartition]:
        pages = -(-self.records // self.page_size)
        return [PageRange(p, min(p + self.per_task, pages)) for p in range(0, pages, self.per_task)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            start = page * self.page_size
            for record in range(start, min(start + self.page_size, self.records)):
                yield page, record


def paged_ids(spark: SparkSession, records: int, page_size: int) -> DataFrame:
    spark.dataSource.register(PagedRecords)
    return spark.read.format("paged_records").option("records", records).option("pageSize", page_size).load()


def write_pages(rows: DataFrame, folder: str, page: str = "page") -> int:
    """Write rows as JSON Lines, one folder per page, and return the row count read back from the files.

    Absent fields are left out of the lines, as the service leaves them out.
    """
    rows.repartition(page).write.mode("errorifexists").partitionBy(page).json(folder)
    return rows.sparkSession.read.text(folder).count()


def ingest_pages(spark: SparkSession, folder: str, records: int, page_size: int, width: int | None = None) -> int:
    """Page files of the deterministic record service."""
    from tracegrain.operators.records import with_fields

    ids = paged_ids(spark, records, page_size)
    rows = with_fields(ids, width)
    # Equal plans: the page is a function of the id.
    rows = rows.withColumn("page", F.floor(F.col("id").cast("long") / page_size))
    return write_pages(rows, folder)

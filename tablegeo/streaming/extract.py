"""Extraction of documents as they arrive.

A page's items arrive together, so each micro-batch is a whole batch of pages: it is extracted by the same
plan as a batch job and written under its batch number; a batch that is tried again overwrites its own
output, which makes the sink exactly-once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablegeo.plans import extract
from tablegeo.schema import ITEMS


def read_items(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files of items."""
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_cells(items: DataFrame, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Cells of each micro-batch under ``output/batch=<n>``; keep what one page needs in one file."""

    def write(batch: DataFrame, number: int) -> None:
        extract.cells(extract.analyzed(batch)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

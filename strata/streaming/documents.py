"""Documents as they arrive: a drop folder of files, parsed by the same kernel as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strata.sources import psd


def arriving(spark: SparkSession, folder: str, table: str, pattern: str = "*.psd", files_per_batch: int = 1000) -> DataFrame:
    """A stream of one table of the documents that arrive in ``folder``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return psd.tables(files, table)


def ingest(spark: SparkSession, folder: str, table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last call to a table of files, then stop."""
    return arriving(spark, folder, table).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

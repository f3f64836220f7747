"""Items and documents as they arrive: catalogue files dropped into a folder, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import split_files


def dropped_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the records of catalogue files as they are dropped into a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return split_files(files)


def arrivals(rows: DataFrame, at: str, key: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows per key and window of arrival; rows later than the watermark are left out."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run work on every micro-batch that is there, then stop (exactly once per batch id)."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

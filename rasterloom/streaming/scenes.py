"""Arriving scenes as a stream (an extension: the scene scripts have no streams).

Pixels or scene records come from files that land in a folder; statistics of event-time windows are kept under a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_statistics(stream: DataFrame, time: str, value: str, width: str = "1 day", late: str = "2 days", by: list[str] = ()) -> DataFrame:
    """Count, mean, least and greatest value of each window; rows later than `late` are left out."""
    window = F.window(time, width)
    grouped = stream.withWatermark(time, late).groupBy(window, *by)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def newest(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Each scene once, however often its files arrive within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

"""Incremental twins of the batch queries: file streams, watermarked windows and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per type and closed hour; works on streams (append mode) and tables. Rows later than `late` are left out of a stream."""
    rows = events.withColumn("t", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("t", late)
    counts = rows.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once: on a table its earliest row (ties: the smallest), on a stream the first to come; a stream forgets keys beyond its watermark."""
    if events.isStreaming:
        return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark([key]).drop("t")
    rest = [c for c in events.columns if c not in (key, "ts")]
    return events.groupBy(key).agg(F.min(F.struct("ts", *rest)).alias("r")).select(key, "r.*").select(*events.columns)

"""Structured Streaming: files are normalised as they arrive, and events are aggregated in event-time windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.normalize import Plan, normalise


def file_stream(spark: SparkSession, path: str, schema: StructType | str, *, format: str = "parquet", max_files: int = 100, **options) -> DataFrame:
    """Files as they appear in a folder."""
    return spark.readStream.format(format).schema(schema).options(**options).option("maxFilesPerTrigger", max_files).load(path)


def ingest(stream: DataFrame, plan: Plan, out: str, checkpoint: str, *, partition_by: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Normalise a stream with the same plan as batches and append it to a lake folder; exactly once, by the checkpoint."""
    w = normalise(stream, plan).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed(events: DataFrame, *, time: str, keys: list[str], value: str, window: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums in event-time windows; rows later than the watermark are dropped by the engine, which bounds its state. The same plan runs on a batch."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, *, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: activity without a gap longer than `gap`."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

"""Structured Streaming front end: manifests that arrive as files, run by the batch functions; windowed progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "sample_id string, image_path string, mask_path string, spacing_at_level_0 double"


def manifests(spark: SparkSession, folder: str, schema: str = MANIFEST) -> DataFrame:
    """Slides from manifest files as they arrive; the same slide listed again within a day counts once."""
    rows = spark.readStream.schema(schema).option("header", True).csv(folder)
    return rows.withColumn("seen", F.current_timestamp()).withWatermark("seen", "1 day").dropDuplicatesWithinWatermark(["sample_id"]).drop("seen")


def run(slides: DataFrame, tile: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of slides goes through the batch function and is appended under its own number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        tile(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return slides.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and totals by event type and tumbling window; late rows are let in for `late` when events is a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

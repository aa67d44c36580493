"""Label rasters split into masks by annotation, and put together again; tiles by annotation are in `tiling`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(label_px: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One binary mask for each declared label."""
    return label_px.join(F.broadcast(vocabulary.select("annotation", "value")), F.col("label") == F.col("value")).select("slide_id", "annotation", "mx", "my")


def combined(masks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Labels put back into one raster: of labels on one pixel the one declared last wins."""
    ordered = masks.join(F.broadcast(vocabulary.select("annotation", "value", "place")), "annotation")
    return ordered.groupBy("slide_id", "mx", "my").agg(F.max(F.struct("place", "value")).alias("m")).select("slide_id", "mx", "my", F.col("m.value").alias("label"))

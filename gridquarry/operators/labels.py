"""Checks and merges of label vocabularies, and of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_labels(pixels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Label values in a raster that no label declares."""
    return pixels.select("slide_id", "label").distinct().join(F.broadcast(vocabulary.select(F.col("value").alias("label"))), "label", "left_anti")


def vocabulary_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names on one side only."""
    a, b = left.select("annotation").distinct(), right.select("annotation").distinct()
    only = lambda x, y, side: x.join(y, "annotation", "left_anti").withColumn("only_in", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def merged_vocabulary(layers: DataFrame) -> DataFrame:
    """Of layered declarations the last one of each name counts; a null value takes the name away."""
    last = layers.groupBy("annotation").agg(F.max(F.struct("layer", "value")).alias("_l"))
    return last.where("_l.value is not null").select("annotation", F.col("_l.value").alias("value"))


def mapping_problems(vocabulary: DataFrame) -> DataFrame:
    """By name: out of 0..255, or a value that another name has too."""
    shared = vocabulary.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    out = vocabulary.join(shared, "value", "left")
    problem = F.when(F.col("value").isNull() | ~F.col("value").between(0, 255), F.lit("range")).when(F.col("_n") > 1, F.lit("shared"))
    return out.withColumn("problem", problem).where("problem is not null").select("annotation", "value", "problem")


def key_differences(found: DataFrame, expected: tuple[str, ...], column: str = "keys") -> DataFrame:
    """Missing and unexpected keys of an array of names."""
    wanted = F.array(*[F.lit(k) for k in expected])
    return found.withColumn("missing", F.array_sort(F.array_except(wanted, F.col(column)))).withColumn("unexpected", F.array_sort(F.array_except(F.col(column), wanted)))


def palette(vocabulary: DataFrame) -> DataFrame:
    """A colour for each label; black where none is declared."""
    return vocabulary.select("value", *(F.coalesce(F.col("color")[k], F.lit(0)).cast("int").alias(c) for k, c in enumerate("rgb")))


def overlay_alpha(pixels: DataFrame, hidden: int, alpha: float) -> DataFrame:
    return pixels.withColumn("alpha", F.when(F.col("label") == hidden, F.lit(0.0)).otherwise(F.lit(alpha)))

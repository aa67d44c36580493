"""Reading slide manifests and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.functions import names

MANIFEST = ("sample_id", "image_path")
RETIRED = ("tissue_mask_path", "annotation_mask_path")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, so that ids like 001 stay what they are."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def check_columns(df: DataFrame, required: tuple[str, ...], retired: tuple[str, ...] = ()) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if old := [c for c in retired if c in df.columns]:
        raise ValueError(f"retired columns: {old}; use mask_path")
    return df


def slides(table: DataFrame) -> DataFrame:
    """sample_id, image_path, mask_path and spacing_at_level_0 of a manifest table."""
    check_columns(table, MANIFEST, RETIRED)
    own = lambda c: F.col(c) if c in table.columns else F.lit(None)
    return table.select(
        F.col("sample_id").cast("string").alias("sample_id"), F.col("image_path").cast("string").alias("image_path"), names.optional_path(own("mask_path").cast("string")).alias("mask_path"), own("spacing_at_level_0").cast("double").alias("spacing_at_level_0")
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file; an id that is there twice is an error."""
    out = slides(read_csv(spark, path))
    twice = out.groupBy("sample_id").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate sample ids: {[r.sample_id for r in twice]}")
    return out


def from_process_list(rows: DataFrame) -> DataFrame:
    """The slides of a run table."""
    return rows.select("sample_id", "image_path", names.optional_path(F.col("mask_path")).alias("mask_path")).distinct()

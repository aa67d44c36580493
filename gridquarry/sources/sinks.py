"""Writing results: coordinates, metadata, archives, run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.functions import names


def coordinates(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each annotation; tiles of a slide stay together and in order."""
    own = tiles.withColumn("annotation", F.coalesce("annotation", F.lit("tissue"))) if "annotation" in tiles.columns else tiles.withColumn("annotation", F.lit("tissue"))
    own.repartition("annotation", "slide_id").sortWithinPartitions("annotation", "slide_id", "tile_index").write.mode(mode).partitionBy("annotation").parquet(path)


def checked_names(rows: DataFrame) -> DataFrame:
    """rows; an annotation that is not safe as a folder is an error."""
    ok = F.col("annotation").isNull() | names.valid_annotation(F.col("annotation"))
    message = F.concat(F.lit("bad annotation name: "), F.col("annotation"))
    return rows.withColumn("annotation", F.when(ok, F.col("annotation")).otherwise(F.raise_error(message)))


def stem() -> Column:
    """Where the files of a result belong: see `names.artifact_stem`."""
    return names.artifact_stem(F.col("sample_id"), F.col("annotation"))


def folder_name(value: str) -> str:
    """A value as Spark writes it in the name of a partition's folder."""
    odd = set('"#%\'*/:=?\\\x7f{[]^') | {chr(k) for k in range(32)}
    return "".join(f"%{ord(c):02X}" if c in odd else c for c in value)


def run_table(rows: DataFrame, path: str) -> None:
    """Status rows, replaced as a whole; null is an empty cell."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def mask_pyramid(levels: DataFrame, path: str) -> None:
    """Levels as folders, so that a read of one level touches nothing else."""
    levels.repartition("level", "slide_id").sortWithinPartitions("level", "slide_id", "my", "mx").write.mode("overwrite").partitionBy("level").parquet(path)


def metadata(rows: DataFrame, path: str) -> None:
    """(sample_id, meta) as JSON lines."""
    rows.select("sample_id", F.parse_json("meta").alias("meta")).select("sample_id", F.to_json("meta").alias("meta")).write.mode("overwrite").json(path)

"""Tiles as a stream of decoded records, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = "slide_id bigint, tile_index int, x bigint, y bigint, width int, height int, data binary"


def tile_records(found: DataFrame, spacing_um: float, size: int, tolerance: float = 0.05, span: int = 8, unreadable: str = "fail") -> DataFrame:
    """found: slide_id, tile_index, x, y, tile, image_path, backend, base_spacing_um.  One row for each tile with its RGB bytes.

    Tiles are dealt out by squares of `span` tiles, so that a task opens few slides, reads
    neighbours together, and no slide has to fit into one task.  Records leave one by one.
    unreadable: fail, or skip tiles that cannot be read (quality control then keeps them).
    """
    side = F.col("tile") * span
    cells = found.select("slide_id", "tile_index", "x", "y", "image_path", "backend", "base_spacing_um", F.floor(F.col("x") / side).alias("_bx"), F.floor(F.col("y") / side).alias("_by"))
    dealt = cells.repartition("slide_id", "_bx", "_by").sortWithinPartitions("slide_id", "_bx", "_by", "tile_index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridquarry.sources.slides import Slide

        path, slide = None, None
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["image_path"] != path:
                        slide = Slide.open(row["image_path"], row["backend"], row["base_spacing_um"])
                        path = row["image_path"]
                    pixels: np.ndarray = slide.region_at(row["x"], row["y"], spacing_um, size, size, tolerance)
                except (OSError, RuntimeError, ValueError):
                    if unreadable != "skip":
                        raise
                    continue
                values = (row["slide_id"], row["tile_index"], row["x"], row["y"], pixels.shape[1], pixels.shape[0], pixels.tobytes())
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["slide_id", "tile_index", "x", "y", "width", "height", "data"])

    return dealt.mapInArrow(read, RECORDS)


def record_pixels(records: DataFrame) -> DataFrame:
    """(slide_id, x, y, px, py, r, g, b): the pixels of the records, for quality control."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rgb = np.frombuffer(row["data"], np.uint8).reshape(-1, 3)
                at_y, at_x = np.divmod(np.arange(len(rgb)), row["width"])
                ones = np.ones(len(rgb), np.int64)
                columns = (row["slide_id"] * ones, row["x"] * ones, row["y"] * ones, at_x, at_y, *(rgb[:, k].astype(np.int32) for k in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slide_id", "x", "y", "px", "py", "r", "g", "b"])

    return records.mapInArrow(spread, "slide_id bigint, x bigint, y bigint, px bigint, py bigint, r int, g int, b int")

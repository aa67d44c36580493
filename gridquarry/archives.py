"""From stored results back to pixels: slides reopened, tile archives with the time they took, previews.

A result is a pair of files below a store's tiles/ folder: arrays and metadata.  The
metadata name the slide, the reader back end and the spacing, so a result is
enough to open its slide again, and nothing has to be tiled anew.
"""

from __future__ import annotations

import io
import json
import tarfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.operators import runs
from gridquarry.outcomes import reason
from gridquarry.sources import artifacts, file_sets, sinks
from gridquarry.sources.slides import Slide
from gridquarry.store import RunStore

PHASES = ("read_s", "encode_s", "write_s")
PARTS = "sample_id string, annotation string, part int, n_tiles int, tar binary, error string, " + ", ".join(f"{p} double" for p in PHASES) + ", total_s double"


class Phases:
    """Seconds spent in each of several phases, one at a time: `with phases("read_s"): ...`."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.spent, self.open = clock, dict.fromkeys(PHASES, 0.0), None

    def __call__(self, name: str) -> Phases:
        self.open = name, self.clock()
        return self

    def __enter__(self) -> None:
        return None

    def __exit__(self, *_) -> None:
        name, began = self.open
        self.spent[name] += self.clock() - began


def reopened(meta: str | dict) -> Slide:
    """The slide of a result, by its metadata."""
    told = json.loads(meta) if isinstance(meta, str) else meta
    own = told["provenance"]
    return Slide.open(own["image_path"], own["backend"], told["slide"]["base_spacing_um"])


def results(store: RunStore, wanted: DataFrame | None = None) -> DataFrame:
    """sample_id, annotation, meta and n_tiles of a store's results; wanted: those pairs only."""
    there = store.settings().select("sample_id", "annotation", "meta", "n_tiles")
    return there if wanted is None else there.join(wanted.select("sample_id", "annotation"), ["sample_id", "annotation"], "left_semi")


def archived(tiles: DataFrame, found: DataFrame, part: int = artifacts.PART, encode: str = "png") -> DataFrame:
    """One row for each `part` tiles of a result: the tar with a picture of each tile, or the error, and the seconds of each phase.

    tiles: sample_id, annotation, tile_index, x, y.  found: from `results`.  A task reads, encodes and
    packs a part by itself, so pixels do not travel; the seconds stand in the row, so a task
    that is run again replaces its own and none count twice.
    """
    draw, end = artifacts.encoder(encode), "png" if encode == "png" else "jpg"
    place = F.struct("tile_index", "x", "y")
    parts = tiles.groupBy("sample_id", "annotation", F.floor(F.col("tile_index") / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(place)).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                phases, began, tar, error = Phases(), time.perf_counter(), None, None
                try:
                    tar = packed(row, phases)
                except Exception as failed:  # noqa: BLE001
                    error = reason(failed)
                values = (row["sample_id"], row["annotation"], row["part"], len(row["places"]), tar, error, *phases.spent.values(), time.perf_counter() - began)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), *[pa.float64()] * (len(PHASES) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

    def packed(row: dict, phases: Phases) -> bytes:
        told = json.loads(row["meta"])
        asked = told["tiling"]
        size, um = asked["requested_tile_size_px"], asked["requested_spacing_um"]
        out = io.BytesIO()
        with phases("read_s"):
            slide = reopened(told)
        with tarfile.open(fileobj=out, mode="w") as tar:
            for p in row["places"]:
                with phases("read_s"):
                    pixels = slide.region_at(p["x"], p["y"], um, size, size, asked["tolerance"])
                with phases("encode_s"):
                    data = draw(pixels)
                with phases("write_s"):
                    info = tarfile.TarInfo(f"{p['tile_index']:06d}.{end}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    return parts.join(found.select("sample_id", "annotation", "meta"), ["sample_id", "annotation"]).repartition("sample_id", "annotation", "part").mapInArrow(run, PARTS)


def save(store: RunStore, wanted: DataFrame | None = None, part: int = artifacts.PART, encode: str = "png") -> DataFrame:
    """Write archives of stored results beside their arrays, STEM.tiles.PART.tar; sample_id, annotation, part, n_tiles, error and seconds of each part."""
    from gridquarry.shared import stored

    tiles = store.tiles().withColumnRenamed("slide_id", "sample_id")
    made = stored(archived(tiles, results(store, wanted), part, encode), "archives")
    one = F.array(F.struct(F.format_string(".tiles.%04d.tar", "part").alias("suffix"), F.col("tar").alias("data")))
    file_sets.write(made.where("error is null").select(sinks.stem().alias("stem"), one.alias("files")), store.at("tiles"))
    return made.drop("tar")


def timings(saved: DataFrame, num_workers: int) -> DataFrame:
    """`runs.store_summary` of what `save` measured."""
    good = saved.where("error is null and total_s > 0")
    return runs.store_summary(good.withColumn("num_workers", F.lit(num_workers)).withColumn("tiles", F.col("n_tiles").cast("bigint")).withColumn("tiles_per_second", F.col("n_tiles") / F.col("total_s")))


def previews(spark: SparkSession, folder: str, side: int = 1024, colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """From the pairs of files below a folder: stem, width, height, n_tiles, image (a PNG of the slide with its tiles outlined) and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.coordinates.*").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+(?:/[^/]+)?)\.coordinates\.(?:npz|meta\.json)$", 1).alias("stem"), F.col("path").endswith(".npz").alias("arrays"), "content")
    pairs = named.groupBy("stem").agg(F.first(F.when(F.col("arrays"), F.col("content")), True).alias("npz"), F.first(F.when(~F.col("arrays"), F.decode("content", "utf-8")), True).alias("meta"))
    kinds = {"stem": pa.string(), "width": pa.int32(), "height": pa.int32(), "n_tiles": pa.int32(), "image": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = [None] * 5
                try:
                    values = [*drawn(row), None]
                except Exception as failed:  # noqa: BLE001
                    values[4] = reason(failed)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((row["stem"], *values), kinds.values(), strict=True)], names=list(kinds))

    def drawn(row: dict) -> tuple[int, int, int, bytes]:
        if row["meta"] is None:
            raise ValueError("arrays without metadata")
        told = json.loads(row["meta"])
        tiles = artifacts.from_npz(row["npz"]) if row["npz"] else None
        slide = reopened(told)
        image = slide.thumbnail(side, side)
        height, width, _ = image.shape
        scale = slide.size[0] / width, slide.size[1] / height
        tile = told["tiling"]["tile_size_lv0"]
        for x, y in () if tiles is None else tiles[["x", "y"]].itertuples(index=False):
            x0, y0 = int(np.ceil(x / scale[0])), int(np.ceil(y / scale[1]))
            x1, y1 = int(np.ceil((x + tile) / scale[0])), int(np.ceil((y + tile) / scale[1]))
            for line in (np.s_[y0 : y0 + 1, x0 : x1 + 1], np.s_[y1 : y1 + 1, x0 : x1 + 1], np.s_[y0 : y1 + 1, x0 : x0 + 1], np.s_[y0 : y1 + 1, x1 : x1 + 1]):
                image[line] = colour
        return width, height, 0 if tiles is None else len(tiles), artifacts.png(image)

    return pairs.mapInArrow(run, "stem string, width int, height int, n_tiles int, image binary, error string")

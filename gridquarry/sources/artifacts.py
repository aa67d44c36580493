"""Stored tile coordinates: compressed array archives with JSON metadata, and tile archives."""

from __future__ import annotations

import importlib
import io
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.operators import provenance

ARRAYS = ("tile_index", "x", "y", "tissue_fractions")
SECTIONS = tuple(provenance.SECTIONS)


def to_npz(tiles: pd.DataFrame) -> bytes:
    tiles = tiles.sort_values(["x", "y"])
    out = io.BytesIO()
    np.savez_compressed(out, tile_index=tiles["tile_index"].to_numpy(np.int32), x=tiles["x"].to_numpy(np.int64), y=tiles["y"].to_numpy(np.int64), tissue_fractions=tiles["frac"].to_numpy(np.float32))
    return out.getvalue()


def from_npz(data: bytes) -> pd.DataFrame:
    with np.load(io.BytesIO(data)) as arrays:
        if missing := [a for a in ARRAYS if a not in arrays.files]:
            raise ValueError(f"arrays missing: {missing}")
        out = pd.DataFrame({a: arrays[a] for a in ARRAYS})
    if (out["tile_index"].to_numpy() != np.arange(len(out))).any():
        raise ValueError("tile_index is not 0..n-1")
    return out


def packed(tiles: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(slide_id, num_tiles, npz): one archive for each slide, which is what the format asks for."""

    def pack(slide: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slide_id": [slide["slide_id"].iloc[0]], "num_tiles": [len(slide)], "npz": [to_npz(slide)]})

    return tiles.select("slide_id", "tile_index", "x", "y", "frac").groupBy("slide_id").applyInPandas(pack, f"slide_id {id_type}, num_tiles int, npz binary")


def unpacked(archives: DataFrame) -> DataFrame:
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for slide, npz in zip(frame["slide_id"], frame["npz"], strict=True):
                yield from_npz(npz).rename(columns={"tissue_fractions": "frac"}).assign(slide_id=slide)[["slide_id", "tile_index", "x", "y", "frac"]]

    return archives.select("slide_id", "npz").mapInPandas(unpack, "slide_id bigint, tile_index int, x bigint, y bigint, frac float")


def read_npz(spark, folder: str) -> DataFrame:
    """Archives below a folder that Spark can reach: sample_id and the arrays."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.coordinates.npz").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.coordinates\.npz$", 1).alias("sample_id"), F.col("content").alias("npz"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample, npz in zip(frame["sample_id"], frame["npz"], strict=True):
                yield from_npz(npz).rename(columns={"tissue_fractions": "frac"}).assign(sample_id=sample)[["sample_id", "tile_index", "x", "y", "frac"]]

    return named.mapInPandas(unpack, "sample_id string, tile_index int, x bigint, y bigint, frac float")


def read_metadata(spark, folder: str) -> DataFrame:
    """Metadata files below a folder, with the sections they lack and those that are too many."""
    from gridquarry.operators.labels import key_differences

    files = spark.read.option("pathGlobFilter", "*.coordinates.meta.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    named = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.coordinates\.meta\.json$", 1).alias("sample_id"), F.col("value").alias("meta"))
    return key_differences(named.withColumn("keys", F.json_object_keys("meta")), SECTIONS).drop("keys")


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def encoder(name: str = "png") -> Callable[[np.ndarray], bytes]:
    """What turns RGB pixels into bytes.  png is always there; pil and turbojpeg make JPEG and need their libraries, and nothing stands in for one that is missing."""
    if name == "png":
        return png
    if name not in ("pil", "turbojpeg"):
        raise ValueError(f"unknown encoder {name!r}")
    try:
        module = importlib.import_module("PIL.Image" if name == "pil" else "turbojpeg")
    except ImportError as error:
        raise RuntimeError(f"encoder {name!r} needs {'Pillow' if name == 'pil' else 'PyTurboJPEG'}") from error
    if name == "turbojpeg":
        return lambda pixels: module.TurboJPEG().encode(np.ascontiguousarray(pixels), quality=90, pixel_format=module.TJPF_RGB)

    def with_pil(pixels: np.ndarray) -> bytes:
        out = io.BytesIO()
        module.fromarray(pixels).save(out, "JPEG", quality=90)
        return out.getvalue()

    return with_pil


#: Tiles in one archive; a slide with more has several, so that a task's memory does not grow with the slide.
PART = 1000


def tile_archives(pixels: DataFrame, part: int | None = None, encode: str = "png") -> DataFrame:
    """pixels: slide_id, tile_index, x, y, r, g, b inside tiles.  Tars of `part` tiles (PART if not stated) with a picture for each: slide_id, part, n_tiles, tar."""
    draw, end = encoder(encode), "png" if encode == "png" else "jpg"

    def picture(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame["x"].max()) + 1, int(frame["y"].max()) + 1
        image = np.zeros((size[1], size[0], 3), np.uint8)
        image[frame["y"], frame["x"]] = frame[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"slide_id": [frame["slide_id"].iloc[0]], "tile_index": [frame["tile_index"].iloc[0]], "data": [draw(image)]})

    return _archived(pixels.groupBy("slide_id", "tile_index").applyInPandas(picture, "slide_id bigint, tile_index int, data binary"), part or PART, end)


def record_archives(records: DataFrame, part: int | None = None, encode: str = "png") -> DataFrame:
    """As tile_archives, from records of decoded tiles (slide_id, tile_index, width, height, data)."""
    draw, end = encoder(encode), "png" if encode == "png" else "jpg"

    def pictures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [draw(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for d, w, h in zip(frame["data"], frame["width"], frame["height"], strict=True)]
            yield frame[["slide_id", "tile_index"]].assign(data=data)

    return _archived(records.select("slide_id", "tile_index", "width", "height", "data").mapInPandas(pictures, "slide_id bigint, tile_index int, data binary"), part or PART, end)


def _archived(pictures: DataFrame, part: int, end: str) -> DataFrame:
    def archive(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for index, data in frame.sort_values("tile_index")[["tile_index", "data"]].itertuples(index=False):
                info = tarfile.TarInfo(f"{index:06d}.{end}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"slide_id": [frame["slide_id"].iloc[0]], "part": [frame["part"].iloc[0]], "n_tiles": [len(frame)], "tar": [out.getvalue()]})

    parts = pictures.withColumn("part", F.floor(F.col("tile_index") / part).cast("int"))
    return parts.groupBy("slide_id", "part").applyInPandas(archive, "slide_id bigint, part int, n_tiles int, tar binary")

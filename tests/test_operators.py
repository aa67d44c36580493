"""Hand-computed cases and invariants."""

import io
import json
import tarfile
import zlib

import numpy as np
import pytest
from gridquarry import config
from gridquarry.functions import colour
from gridquarry.functions import geometry as g
from gridquarry.operators import components as cc
from gridquarry.operators import coverage as cv
from gridquarry.operators import grid, levels, qc, runs, sampling, supertiles, tiling
from gridquarry.sources import artifacts, manifest, rasters, sinks
from gridquarry.streaming import frontend
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounding_is_half_to_even(spark):
    got = spark.range(1).select(g.project_size(F.lit(5.0), F.lit(0.5)), g.tile_step(F.lit(7.0), F.lit(0.5)), g.project_origin(F.lit(15), F.lit(0.1))).first()
    assert tuple(got) == (2, 4, 1)


@pytest.mark.parametrize(("size", "mask", "x", "tile", "want"), [(100, [(mx, my) for mx in range(100) for my in range(100)], 80, 80, 0.0625), (30, [(1, 1)], 15, 10, 1.0)])
def test_coverage_counts_the_whole_tile(spark, size, mask, x, tile, want):
    side = 100 if size == 100 else 3
    tiles = spark.createDataFrame([(1, x, x, tile, size, size)], "slide_id bigint, x bigint, y bigint, tile bigint, slide_w bigint, slide_h bigint")
    px = spark.createDataFrame([(1, a, b) for a, b in mask], "slide_id bigint, mx bigint, my bigint")
    assert cv.covered(cv.windows(tiles, side, side), px, ["slide_id"]).first().frac == pytest.approx(want)


def test_coverage_forms_agree(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((32, 32)) < 0.4
    px = spark.createDataFrame([(1, int(x), int(y)) for y, x in np.argwhere(mask)], "slide_id bigint, mx bigint, my bigint")
    slides = spark.createDataFrame([(1, 1000, 900)], "slide_id bigint, slide_w bigint, slide_h bigint")
    tiles = cv.windows(grid.candidates(grid.slide_boxes(slides), 130, 70, ("slide_id", "slide_w", "slide_h")), 32, 32)
    joined = {(r.x, r.y): r.n_px for r in cv.covered(tiles, px, ["slide_id"], zero=True).collect()}
    summed = {(r.x, r.y): r.n_px for r in cv.coverage_from_integral(tiles, cv.integral_image(px, slides, 32, 32), 32, 32).collect()}
    plain = {(r.x, r.y): int(mask[r.wy : r.wy + r.wh, r.wx : r.wx + r.ww].sum()) for r in tiles.collect()}
    assert joined == summed == plain


def test_level_walk(spark):
    pyramid = spark.createDataFrame([(1, 0, 100, 100, 1.0, 1.0, 1.0), (1, 1, 50, 50, 2.0, 2.0, 2.0)], "slide_id bigint, level int, width bigint, height bigint, downsample_x double, downsample_y double, spacing_um double")
    slides = spark.createDataFrame([(1, 1.0)], "slide_id bigint, base_spacing_um double")
    wishes = spark.createDataFrame([(2.1, 0.10), (3.5, 0.01), (0.5, 0.01), (1.5, 0.01)], "requested double, tolerance double")
    got = levels.with_policy(levels.select_by_spacing(levels.with_levels(slides, pyramid).crossJoin(wishes))).select("requested", "read_level", "is_near", "upsample_violation")
    assert rows(got) == [(0.5, 0, False, True), (1.5, 0, False, False), (2.1, 1, True, False), (3.5, 1, False, False)]


def test_index_is_dense_and_first_wins(spark):
    tiles = spark.createDataFrame([(1, 5, 0, 2, 0.5), (1, 5, 0, 1, 0.1), (1, 0, 9, 3, 0.2), (1, 0, 3, 3, 0.9)], "slide_id bigint, x bigint, y bigint, contour int, frac double")
    kept = grid.indexed(grid.dedup_first(tiles, ["slide_id", "x", "y"], ["contour"]), ["slide_id"])
    assert rows(kept.select("tile_index", "x", "y", "frac")) == [(0, 0, 3, 0.9), (1, 0, 9, 0.2), (2, 5, 0, 0.1)]
    assert grid.contiguous(kept, ["slide_id"]).first().contiguous
    assert grid.candidates(spark.createDataFrame([(1, 5, 5, 5, 9)], "slide_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"), 8, 4).count() == 0


def test_stride(spark):
    frame = lambda points: spark.createDataFrame([(1, x, y) for x, y in points], "slide_id bigint, x bigint, y bigint")
    assert [grid.stride(frame(p), "slide_id", 7).first().step for p in ([(0, 0), (24, 0), (96, 0)], [(0, 0), (0, 30)], [(3, 3)])] == [24, 30, 7]


def test_components_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 4)
    snake = [(x, 0) for x in range(13)] + [(12, y) for y in range(1, 13)] + [(x, 12) for x in range(12)] + [(3, 6), (4, 7), (8, 3)]
    labelled = cc.components(spark.createDataFrame([(1, x, y) for x, y in snake], "slide_id bigint, mx bigint, my bigint"), 16)
    assert rows(cc.areas(labelled).select("component", "area")) == [(0, 37), (3 * 16 + 8, 1), (6 * 16 + 3, 2)]


def test_holes(spark):
    ring = [(x, y) for x in range(2, 7) for y in range(2, 7) if (x, y) not in ((4, 4), (3, 3))]
    mask = spark.createDataFrame([(1, x, y) for x, y in ring], "slide_id bigint, mx bigint, my bigint")
    slides = spark.createDataFrame([(1,)], "slide_id bigint")
    assert rows(cc.hole_parents(cc.holes(mask, slides, 9, 9), cc.components(mask, 9)).select("area", "parent")) == [(2, 2 * 9 + 2)]
    assert cc.filled(mask, slides, 9, 9, 2).count() == 25
    assert cc.filled(mask, slides, 9, 9, 1).count() == 23


def test_grey_tiles_are_rejected(spark):
    tile = lambda k, r, gr, b: [(k, x, y, r, gr, b) for x in range(4) for y in range(4)]
    px = spark.createDataFrame(tile(1, 150, 150, 150) + tile(2, 200, 130, 170) + tile(3, 255, 255, 255), "tile int, x int, y int, r int, g int, b int")
    got = {r.tile: (r.white, r.grey, r.blur, r.keep) for r in qc.checked(px, ["tile"], qc.Limits(blur_least=None)).collect()}
    assert got == {1: (0.0, 1.0, 0.0, False), 2: (0.0, 0.0, 0.0, True), 3: (1.0, 1.0, 0.0, False)}
    none = px.withColumn("valid", F.lit(False))
    assert {r.white for r in qc.shares(none, ["tile"]).collect()} == {0.0}


def test_colour(spark):
    px = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0), (100, 150, 200)], "r int, g int, b int")
    got = px.select(colour.hue(F.col("r"), F.col("g"), F.col("b")), colour.saturation(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0, 255), (60, 255), (120, 255), (0, 0), (105, 128)]


def test_supertiles(spark):
    tiles = grid.indexed(spark.createDataFrame([(1, 32 * i, 32 * j) for i in range(4) for j in range(4)] + [(1, 32 * 9, 0)], "slide_id bigint, x bigint, y bigint"), ["slide_id"])
    for blocked in (supertiles.aligned_blocks(tiles, 32), supertiles.greedy(tiles, 32)):
        assert rows(blocked.groupBy("block_size").count()) == [(1, 1), (4, 16)]
    index = supertiles.index(supertiles.aligned_blocks(tiles, 32), 32, 8)
    assert rows(index.where("x = 32 and y = 64").select("st_id", "crop_x", "crop_y")) == [(0, 8, 16)]
    assert rows(supertiles.plans(supertiles.aligned_blocks(tiles, 32), 16, 8).select("read_size_px", "n_tiles")) == [(16, 1), (40, 16)]


def test_joint_keeps_thresholds(spark):
    px = spark.createDataFrame([(1, x, y, 1 if x < 8 else 2) for x in range(16) for y in range(16)], "slide_id bigint, mx bigint, my bigint, label int")
    vocabulary = spark.createDataFrame([("a", 1, 0.1, 1), ("b", 2, 0.5, 2)], "annotation string, value int, min_coverage double, place int")
    slides = spark.createDataFrame([(1, 160, 160, 0.5)], "slide_id bigint, slide_w bigint, slide_h bigint, base_spacing_um double")
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit(1.0).alias("downsample_x"), F.lit(0.5).alias("spacing_um"), F.col("slide_w").alias("width"), F.col("slide_h").alias("height")))
    asked = (sampling.split(px, vocabulary), slides.withColumn("levels", levels), vocabulary, 16, 16, tiling.Spec(tile_px=64, spacing_um=0.5, overlap=0.25))
    got = tiling.joint(*asked)
    assert {r.annotation for r in got.collect()} == {"a", "b"}
    assert got.where("annotation = 'b' and frac < 0.5").count() == 0
    assert all(r.contiguous for r in grid.contiguous(got, ["slide_id", "annotation"]).collect())
    merged = tiling.per_annotation(*asked, "joint", "merged")
    assert merged.count() == got.select("x", "y").distinct().count()


def test_failed_reasons_and_resume(spark):
    table = spark.createDataFrame([(1, "s", "failed", " x "), (2, "s", "failed", "y"), (3, "s", "failed", "x"), (4, "t", "failed", None), (5, "u", "success", None)], "row_id int, sample_id string, tiling_status string, error string")
    assert rows(runs.failed_slides(table)) == [("s", "x | y"), ("t", "unknown error")]


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("sample_id,image_path,mask_path\n001,/a.svs,\nNA,/b.svs,nan\n")
    assert rows(manifest.load(spark, str(path))) == [("001", "/a.svs", None, None), ("NA", "/b.svs", None, None)]
    path.write_text("sample_id,image_path\n1,/a\n1,/b\n")
    with pytest.raises(ValueError, match="duplicate"):
        manifest.load(spark, str(path))
    path.write_text("sample_id,image_path,tissue_mask_path\n1,/a,/m\n")
    with pytest.raises(ValueError, match="retired"):
        manifest.load(spark, str(path))


def test_artifacts(spark, tmp_path):
    tiles = grid.indexed(spark.createDataFrame([(1, 5, 1, 0.5), (1, 0, 9, 0.25), (2, 3, 3, 1.0)], "slide_id bigint, x bigint, y bigint, frac float"), ["slide_id"])
    back = artifacts.unpacked(artifacts.packed(tiles))
    assert rows(back.select("slide_id", "tile_index", "x", "y", "frac")) == rows(tiles.select("slide_id", "tile_index", "x", "y", "frac"))
    for r in artifacts.packed(tiles).collect():
        (tmp_path / f"s{r.slide_id}.coordinates.npz").write_bytes(bytes(r.npz))
        (tmp_path / f"s{r.slide_id}.coordinates.meta.json").write_text(json.dumps({s: {} for s in artifacts.SECTIONS}) if r.slide_id == 1 else json.dumps({"odd": 1}))
    assert artifacts.read_npz(spark, str(tmp_path)).count() == 3
    meta = {r.sample_id: (len(r.missing), list(r.unexpected)) for r in artifacts.read_metadata(spark, str(tmp_path)).collect()}
    assert meta == {"s1": (0, []), "s2": (6, ["odd"])}
    with pytest.raises(ValueError, match="0..n-1"):
        artifacts.from_npz(_npz(tile_index=[1]))
    sinks.coordinates(tiles, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def _npz(tile_index):
    out = io.BytesIO()
    np.savez_compressed(out, tile_index=np.array(tile_index), x=np.zeros(1), y=np.zeros(1), tissue_fractions=np.zeros(1))
    return out.getvalue()


def test_archives_and_png(spark, tmp_path):
    px = spark.createDataFrame([(1, t, x, y, 10 * t, x, y) for t in range(2) for x in range(3) for y in range(2)], "slide_id bigint, tile_index int, x int, y int, r int, g int, b int")
    tar = tarfile.open(fileobj=io.BytesIO(bytes(artifacts.tile_archives(px).first().tar)))
    assert tar.getnames() == ["000000.png", "000001.png"]
    image = rasters.decode_png(tar.extractfile("000001.png").read())
    assert image.shape == (2, 3, 3)
    assert image[1, 2].tolist() == [10, 2, 1]
    (tmp_path / "a.png").write_bytes(artifacts.png(image))
    assert rows(rasters.png_sizes(spark, str(tmp_path)).select("width", "height", "too_large")) == [(3, 2, False)]
    spark.dataSource.register(rasters.Regions)
    got = spark.read.format("slide_regions").option("path", str(tmp_path / "a.png")).option("spacing", "0.5").option("regions", "[[1,0,2,2,0],[-1,-1,2,2,0]]").load()
    assert rows(rasters.pixels(got).where("x = 2 and y = 1").select("r", "g", "b")) == [(10, 2, 1)]
    assert rows(rasters.pixels(got).where("x = -1 and y = -1").select("r")) == [(255,)]
    with pytest.raises(ValueError, match="limit"):
        rasters.decode_png(artifacts.png(image), limit=5)
    with pytest.raises(ValueError, match="explicit spacing"):
        rasters.open_raster(str(tmp_path / "a.png"), "pil")
    assert rasters.flat_images(spark, str(tmp_path)).first().width == 3


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (5, 7, 3)).astype(np.int32)
    above, lines = np.zeros(21, np.int32), b""
    for y in range(5):
        line = want[y].ravel()
        left, corner = np.append(np.zeros(3, int), line[:-3]), np.append(np.zeros(3, int), above[:-3])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = {1: left, 2: above, 3: (left + above) // 2, 4: near}[kind]
        lines += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    data = artifacts.png(want)
    head = data[: data.index(b"IDAT") - 4]
    body = zlib.compress(lines)
    assert (rasters.decode_png(head + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0") == want).all()


def test_config():
    values = config.load(arguments=["tiling.tile_px=512", "tiling.min_coverage.tissue=0.2"], defaults={"tiling": {"tile_px": 256, "overlap": 0.5}})
    tiling = config.build(config.Tiling, values["tiling"])
    assert (tiling.tile_px, tiling.overlap, tiling.tissue_fraction()) == (512, 0.5, 0.2)
    with pytest.raises(ValueError, match="unknown keys"):
        config.build(config.Tiling, {"tissue_threshold": 0.1})
    with pytest.raises(ValueError, match="backend"):
        config.Tiling(backend="magic")
    with pytest.raises(ValueError, match="distinct"):
        config.validate_labels({"a": 1, "b": 1})
    config.validate_labels({"a": 1, "b": 2}, {"a": [1, 2, 3], "b": None}, ("a",))
    assert config.merged({"a": 1, "b": {"c": 2, "d": 3}}, {"b": {"c": None}}) == {"a": 1, "b": {"d": 3}}


def test_streaming_front_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text("sample_id,image_path,mask_path,spacing_at_level_0\na,/a,,\nb,/b,,0.5\n")
    (source / "2.csv").write_text("sample_id,image_path,mask_path,spacing_at_level_0\na,/a,,\n")
    query = frontend.run(frontend.manifests(spark, str(source)), lambda slides: slides.select("sample_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("sample_id")) == [("a",), ("b",)]

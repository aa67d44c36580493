"""Queries on geometry, levels, grids and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.functions import geometry as g
from gridquarry.operators import coverage as cv
from gridquarry.operators import grid, levels
from gridquarry.plans.fixtures import CANDIDATES, SIDE, Fixtures
from gridquarry.plans.registry import query

#: Nearest level with the walk to finer ones, for DuckDB.
CHOSEN = """with off as (select p.slide_id, w.requested, w.tolerance, p.level, p.spacing_um, s.base_spacing_um, abs(p.spacing_um - w.requested) off from pyramid p cross join wishes w join slides s using (slide_id)),
 best as (select *, row_number() over (partition by slide_id, requested order by off, level) k from off),
 near as (select * from best where k=1),
 walked as (select n.slide_id, n.requested, n.tolerance, n.base_spacing_um, case when n.off / n.requested <= n.tolerance or n.spacing_um <= n.requested then n.level
 else coalesce((select max(o.level) from off o where o.slide_id=n.slide_id and o.requested=n.requested and o.level<n.level and o.spacing_um<=n.requested), 0) end read_level from near n),
 chosen as (select w.*, p.spacing_um read_spacing_um, abs(p.spacing_um - w.requested) / w.requested <= w.tolerance is_near from walked w join pyramid p on p.slide_id=w.slide_id and p.level=w.read_level)
"""


@query("select slide_id, mx, my, cast(floor(mx * (cast(32 as double)/slide_w)) as bigint) px, cast(floor(my * cast(0.25 as double)) as bigint) py from mask_px join slides using (slide_id)", "slides", "mask_px")
def project_origins(f: Fixtures) -> DataFrame:
    both = f.mask_px.join(f.slides, "slide_id")
    return both.select("slide_id", "mx", "my", g.project_origin(F.col("mx"), F.lit(float(SIDE)) / F.col("slide_w")).alias("px"), g.project_origin(F.col("my"), F.lit(0.25)).alias("py"))


@query("select slide_id, cast(round_even(256 * (2 * base_spacing_um) / base_spacing_um, 0) as bigint) tile_lv0, cast(greatest(1.0, round_even(slide_w * (cast(1 as double) - cast(0.3 as double)), 0)) as bigint) step_lv0 from slides", "slides")
def tile_footprint(f: Fixtures) -> DataFrame:
    base = F.col("base_spacing_um")
    return f.slides.select("slide_id", g.tile_footprint(F.lit(256), 2 * base, base).alias("tile_lv0"), g.tile_step(F.col("slide_w"), F.lit(0.3)).alias("step_lv0"))


@query("select s.slide_id, x, y from (select *, unnest(range(0, slide_w, 96)) x from slides) s, unnest(range(0, s.slide_h, 96)) u(y)", "slides")
def candidate_grid(f: Fixtures) -> DataFrame:
    return grid.candidates(grid.slide_boxes(f.slides), 128, 96).select("slide_id", "x", "y")


@query(CANDIDATES + "select slide_id, x, y, n_px, frac from scored where frac >= cast(0.4 as float)", "slides", "mask_px")
def tile_coverage(f: Fixtures) -> DataFrame:
    tiles = cv.windows(grid.candidates(grid.slide_boxes(f.slides), 128, 96, ("slide_id", "slide_w", "slide_h")), SIDE, SIDE)
    return cv.at_least(cv.covered(tiles, f.mask_px, ["slide_id"]), 0.4).select("slide_id", "x", "y", "n_px", "frac")


@query(CANDIDATES + "select slide_id, x, y, frac, tile_index from tiles", "slides", "mask_px")
def tile_index(f: Fixtures) -> DataFrame:
    return f.tiles.select("slide_id", "x", "y", "frac", "tile_index")


@query(CANDIDATES + "select slide_id, x, y, frac, tile_index from tiles where tile_index < 5", "slides", "mask_px")
def limit_tiles(f: Fixtures) -> DataFrame:
    return grid.limited(f.tiles, 5).select("slide_id", "x", "y", "frac", "tile_index")


@query("with d as (select slide_id, mx+1 ix, my+1 iy from (select slide_id, unnest(range(0,32)) mx from slides) a, unnest(range(0,32)) u(my)) select d.slide_id, d.ix, d.iy, count(m.mx) total from d left join mask_px m on m.slide_id=d.slide_id and m.mx<d.ix and m.my<d.iy group by all", "slides", "mask_px")
def integral_image(f: Fixtures) -> DataFrame:
    return cv.integral_image(f.mask_px, f.slides, SIDE, SIDE)


@query(CANDIDATES + "select c.slide_id, c.x, c.y, coalesce(n_px, 0) n_px from cand c left join scored s using (slide_id, x, y)", "slides", "mask_px")
def coverage_by_integral(f: Fixtures) -> DataFrame:
    tiles = cv.windows(grid.candidates(grid.slide_boxes(f.slides), 128, 96, ("slide_id", "slide_w", "slide_h")), SIDE, SIDE)
    return cv.coverage_from_integral(tiles, cv.integral_image(f.mask_px, f.slides, SIDE, SIDE), SIDE, SIDE)


@query("select slide_id, level, cast(first_value(width) over (partition by slide_id order by level) as double) / width downsample_x, cast(first_value(height) over (partition by slide_id order by level) as double) / height downsample_y from pyramid", "pyramid")
def level_downsamples(f: Fixtures) -> DataFrame:
    return levels.level_downsamples(f.pyramid).select("slide_id", "level", "downsample_x", "downsample_y")


@query("select slide_id, level, base_spacing_um * (cast(first_value(width) over (partition by slide_id order by level) as double) / width) spacing_um from pyramid join slides using (slide_id)", "slides", "pyramid")
def level_spacings(f: Fixtures) -> DataFrame:
    return levels.level_spacings(f.pyramid, f.slides).select("slide_id", "level", "spacing_um")


@query("with o as (select slide_id, requested, level, row_number() over (partition by slide_id, requested order by abs(downsample_x-requested), level) k from pyramid cross join wishes) select slide_id, requested, level chosen_level from o where k=1", "pyramid", "wishes")
def select_level_downsample(f: Fixtures) -> DataFrame:
    return levels.select_by_downsample(f.wished).select("slide_id", "requested", "chosen_level")


@query(CHOSEN + "select slide_id, requested, read_level, read_spacing_um, is_near from chosen", "slides", "pyramid", "wishes")
def select_level_spacing(f: Fixtures) -> DataFrame:
    return levels.select_by_spacing(f.wished).select("slide_id", "requested", "read_level", "read_spacing_um", "is_near")


@query(CHOSEN.replace("n.off / n.requested <= n.tolerance or ", "") + "select slide_id, requested, read_level, read_spacing_um from chosen", "slides", "pyramid", "wishes")
def select_mask_level(f: Fixtures) -> DataFrame:
    return levels.mask_level(f.wished).select("slide_id", "requested", "read_level", "read_spacing_um")


@query(CHOSEN + "select slide_id, requested, requested < base_spacing_um and not is_near upsample_violation from chosen", "slides", "pyramid", "wishes")
def spacing_policy(f: Fixtures) -> DataFrame:
    return levels.with_policy(levels.select_by_spacing(f.wished)).select("slide_id", "requested", "upsample_violation")


@query(CHOSEN + "select slide_id, requested, case when is_near then 224 else cast(round_even(224 * (requested/read_spacing_um), 0) as bigint) end read_w, case when is_near then 200 else cast(round_even(200 * (requested/read_spacing_um), 0) as bigint) end read_h from chosen", "slides", "pyramid", "wishes")
def plan_spacing_read(f: Fixtures) -> DataFrame:
    return levels.read_plan(levels.select_by_spacing(f.wished), 224, 200).select("slide_id", "requested", "read_w", "read_h")


@query(CHOSEN + "select slide_id, requested, read_level, cast(greatest(1.0, round_even(cast(128 as double)/requested, 0)) as bigint) qc_px, cast(greatest(1.0, round_even(cast(128 as double)/read_spacing_um, 0)) as bigint) read_px from chosen", "slides", "pyramid", "wishes")
def qc_geometry(f: Fixtures) -> DataFrame:
    return levels.qc_geometry(levels.select_by_spacing(f.wished), 256, 0.5).select("slide_id", "requested", "read_level", "qc_px", "read_px")


@query(
    """with r as (select slide_id, level, k, cast((k-2)*600 as bigint) x, cast((k-1)*500 as bigint) y, width, height, downsample_x from pyramid, unnest(range(0,5)) u(k)),
 p as (select *, cast(floor(x/downsample_x) as bigint) lx, cast(floor(y/downsample_x) as bigint) ly from r)
 select slide_id, level, x, y, lx, ly, greatest(0, least(lx+256, width)-greatest(lx,0)) inside_w, greatest(0, least(ly+256, height)-greatest(ly,0)) inside_h, greatest(0,-lx) paste_x, greatest(0,-ly) paste_y from p""",
    "pyramid",
)
def padded_read_bounds(f: Fixtures) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    reads = f.pyramid.withColumn("k", k).withColumn("x", ((F.col("k") - 2) * 600).cast("bigint")).withColumn("y", ((F.col("k") - 1) * 500).cast("bigint"))
    reads = reads.withColumn("w", F.lit(256)).withColumn("h", F.lit(256))
    return levels.padded_bounds(reads).select("slide_id", "level", "x", "y", "lx", "ly", "inside_w", "inside_h", "paste_x", "paste_y")


@query("select slide_id, cast(greatest(1.0, round_even(slide_w*base_spacing_um/cast(8 as double), 0)) as bigint) thumb_w, cast(greatest(1.0, round_even(slide_h*base_spacing_um/cast(8 as double), 0)) as bigint) thumb_h from slides", "slides")
def thumbnail_plan(f: Fixtures) -> DataFrame:
    from gridquarry.operators.segmentation import thumbnail_plan as plan

    return plan(f.slides).select("slide_id", "thumb_w", "thumb_h")


@query("select sample_id, coalesce(override_um, native_um) spacing_um, override_um is not null and native_um is not null and override_um <> native_um disagree, override_um is null and native_um is null missing from manifest", "manifest")
def resolve_spacing(f: Fixtures) -> DataFrame:
    return levels.resolve_spacing(f.manifest).select("sample_id", "spacing_um", "disagree", "missing")


@query("select slide_id, level, case when level=0 then 0 else cast(greatest(1.0, round_even(cast(level*40 as double)/(spacing_um*spacing_um), 0)) as bigint) end area_px, case when level=0 then 0 else cast(greatest(1.0, round_even(cast(level*3 as double)/spacing_um, 0)) as bigint) end length_px from pyramid", "pyramid")
def unit_conversion(f: Fixtures) -> DataFrame:
    um = F.col("level").cast("double")
    return f.pyramid.select("slide_id", "level", g.pixels_of_area(um * 40, F.col("spacing_um")).alias("area_px"), g.pixels_of_length(um * 3, F.col("spacing_um")).alias("length_px"))


@query("select slide_id, level, width*height > 700000 too_large from pyramid", "pyramid")
def mask_size_guard(f: Fixtures) -> DataFrame:
    return levels.size_guard(f.pyramid, 700_000).select("slide_id", "level", "too_large")


DOUBLED = "with t as (select slide_id, mx % 8 x, my % 8 y, mx seq, mx*32+my contour_id from mask_px)"


@query(DOUBLED + ", o as (select *, row_number() over (partition by slide_id, x, y order by contour_id, seq) k from t) select slide_id, x, y, contour_id, seq from o where k=1", "mask_px")
def dedup_first(f: Fixtures) -> DataFrame:
    tiles = f.mask_px.select("slide_id", (F.col("mx") % 8).alias("x"), (F.col("my") % 8).alias("y"), (F.col("mx") * 32 + F.col("my")).alias("contour_id"), F.col("mx").alias("seq"))
    return grid.dedup_first(tiles, ["slide_id", "x", "y"], ["contour_id", "seq"])


@query(
    CANDIDATES
    + """, lab as (select l.slide_id, v.annotation, l.mx, l.my from label_px l join vocabulary v on l.label=v.value),
 ar as (select slide_id, annotation, count(*) px from lab group by all),
 hit as (select c.slide_id, l.annotation, c.x, c.y, cast(cast(count(*) as double)/any_value(ww*wh) as float) frac from cand c join lab l on l.slide_id=c.slide_id and l.mx>=wx and l.mx<wx+ww and l.my>=wy and l.my<wy+wh group by all),
 est as (select h.slide_id, h.annotation, count(*) n from hit h join vocabulary v using (annotation) where h.frac >= cast(v.min_coverage as float) group by all)
 select a.slide_id, a.annotation, a.px * (cast(2 as double)/1000)*(cast(2 as double)/1000) area_mm2, case when v.min_coverage is not null then a.px / cast(sum(case when v.min_coverage is not null then a.px end) over (partition by a.slide_id) as double) end frac,
 case when v.min_coverage is not null then coalesce(e.n, 0) end est_tiles from ar a join vocabulary v using (annotation) left join est e on e.slide_id=a.slide_id and e.annotation=a.annotation""",
    "slides",
    "mask_px",
    "label_px",
    "vocabulary",
)
def coverage_summary(f: Fixtures) -> DataFrame:
    from gridquarry.operators.sampling import split

    tiles = cv.windows(grid.candidates(grid.slide_boxes(f.slides), 128, 96, ("slide_id", "slide_w", "slide_h")), SIDE, SIDE)
    return cv.coverage_summary(split(f.label_px, f.vocabulary), f.vocabulary, tiles, 2.0)


@query(CANDIDATES + "select slide_id, count(*) num_tiles, cast(count(*) as double) / (px * (slide_w/cast(32 as double)) * (slide_h/cast(32 as double)) / 9216) ratio from tiles join (select slide_id, count(*) px from mask_px group by 1) using (slide_id) join slides using (slide_id) group by slide_id, px, slide_w, slide_h", "slides", "mask_px")
def tile_count_heuristic(f: Fixtures) -> DataFrame:
    """Tiles against tissue area over the square of the step."""
    area = f.mask_px.groupBy("slide_id").agg(F.count(F.lit(1)).alias("px")).join(f.slides, "slide_id")
    counts = f.tiles.groupBy("slide_id").agg(F.count(F.lit(1)).alias("num_tiles"))
    expected = F.col("px") * (F.col("slide_w") / SIDE) * (F.col("slide_h") / SIDE) / 9216
    return counts.join(area, "slide_id").select("slide_id", "num_tiles", (F.col("num_tiles") / expected).alias("ratio"))


@query(CANDIDATES + ", g as (select slide_id, x - lag(x) over (partition by slide_id order by x) d from (select distinct slide_id, x from tiles)) select slide_id, min(d) step from g group by 1", "slides", "mask_px")
def infer_stride(f: Fixtures) -> DataFrame:
    return grid.stride(f.tiles, "slide_id", 96)


@query(CANDIDATES + "select slide_id, count(*) num_tiles, true contiguous from tiles group by 1", "slides", "mask_px")
def tile_index_contiguity(f: Fixtures) -> DataFrame:
    return grid.contiguous(f.tiles, ["slide_id"])

"""Queries on sampling, quality control, segmentation, components and supertiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.operators import components as cc
from gridquarry.operators import outlines, qc, rendering, sampling, supertiles, tiling
from gridquarry.operators import segmentation as seg
from gridquarry.plans.fixtures import CANDIDATES, SIDE, Fixtures
from gridquarry.plans.registry import again, query

LABELLED = "with lab as (select l.slide_id, v.annotation, l.mx, l.my from label_px l join vocabulary v on l.label=v.value)"


#: Blocks of the component queries: smaller than the rasters, so that labels pass borders.
BLOCK = 16


FOUR = "(values (1,0),(-1,0),(0,1),(0,-1))"
EIGHT = "(values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1))"


def beside(name: str, pixels: str, four: bool) -> str:
    """{name}_adj: every pixel of pixels(k, mx, my) with each neighbour (ox, oy)."""
    return f"{name}_adj as materialized (select a.k, a.mx, a.my, b.mx ox, b.my oy from {pixels} a cross join {FOUR if four else EIGHT} d(dx, dy) join {pixels} b on b.k=a.k and b.mx=a.mx+d.dx and b.my=a.my+d.dy)"


def walk(name: str, pixels: str, four: bool = False) -> str:
    """Components for DuckDB: {name}(k, mx, my, component) of pixels(k, mx, my), by passing the smallest place on."""
    return f"""{beside(name, pixels, four)}, {name}_walk(k, mx, my, root) using key (k, mx, my) as (select k, mx, my, my*32+mx from {pixels} union
 select n.k, n.ox, n.oy, min(w.root) from {name}_walk w join {name}_adj n on n.k=w.k and n.mx=w.mx and n.my=w.my join recurring.{name}_walk o on o.k=n.k and o.mx=n.ox and o.my=n.oy where w.root<o.root group by all),
 {name} as (select k, mx, my, root component from {name}_walk)"""


#: The places of background that no way by four neighbours leads to from the raster's edge.
ENCLOSED = beside("back", "back_px", True) + ", reach(k, mx, my) as (select k, mx, my from back_px where mx in (0,31) or my in (0,31) union select n.k, n.ox, n.oy from reach r join back_adj n on n.k=r.k and n.mx=r.mx and n.my=r.my), enclosed as (select k, mx, my from back_px anti join reach using (k, mx, my))"
#: Places of a raster that are not of the mask px(k, mx, my).
BACK = "back_px as (select a.k, a.mx, u.my from (select k, unnest(range(0,32)) mx from (select distinct k from px)) a cross join unnest(range(0,32)) u(my) anti join px m on m.k=a.k and m.mx=a.mx and m.my=u.my)"
INNER = "inn as (select k, component, count(*) area from back group by all having min(mx)>0 and min(my)>0 and max(mx)<31 and max(my)<31)"
PX = "with recursive px as (select slide_id k, mx, my from mask_px), "
REACH = PX + walk("fg", "px") + ", comp as (select k slide_id, mx, my, component from fg), ar as (select slide_id, component, count(*) area, min(mx) x0, min(my) y0, max(mx) x1, max(my) y1 from comp group by all)"
SQUARES = "tr as (select k, component, cast(sum(case n when 4 then 1.0 when 3 then 0.5 else 0.0 end) as double) area from (select k, component, mx+dx sx, my+dy sy, count(*) n from fg, unnest([-1,0]) a(dx), unnest([-1,0]) b(dy) group by all) group by all)"



@query(LABELLED + " select slide_id, annotation, mx, my from lab", "label_px", "vocabulary")
def annotation_split(f: Fixtures) -> DataFrame:
    return sampling.split(f.label_px, f.vocabulary)


SPEC = tiling.Spec(tile_px=256, spacing_um=0.5, overlap=0.25, min_coverage=0.3)


def contour_tiles(limit: float) -> str:
    """kept(k, slide_id, x, y, contour_id, frac) for DuckDB, from px(k, mx, my) and key(k, slide_id): tiles of contours, each on a grid of its own."""
    return (
        walk("fg", "px") + ", " + SQUARES + ", " + BACK + ", " + ENCLOSED
        + f""", rim as (select distinct k, mx+dx mx, my+dy my from enclosed, {FOUR} d(dx,dy)),
 sized as (select key.k, slide_id, slide_w, slide_h, slide_w/cast(32 as double) sx, slide_h/cast(32 as double) sy, cast(round_even(256*cast(0.5 as double)/base_spacing_um,0) as bigint) tile, 16*(cast(0.5 as double)/base_spacing_um) rt from slides join key using (slide_id)),
 grids as (select *, cast(greatest(1.0, round_even(tile*(cast(1 as double)-cast(0.25 as double)),0)) as bigint) step from sized),
 ext as (select k, component contour_id, min(mx) ax, max(mx) bx, min(my) ay, max(my) b_y from fg group by all),
 boxes as (select g.*, contour_id, cast(floor(ax*sx) as bigint) x0, cast(floor(ay*sy) as bigint) y0, least(cast(floor(bx*sx) as bigint)+1, slide_w) x1, least(cast(floor(b_y*sy) as bigint)+1, slide_h) y1 from ext join grids g using (k)),
 big as (select boxes.* from boxes join tr on tr.k=boxes.k and tr.component=boxes.contour_id where area > 0 and area > 4*floor((rt/sx)*(rt/sy))),
 inside as (select fg.k, fg.component, fg.mx, fg.my from fg anti join rim using (k, mx, my)),
 cand as (select b.*, x, y from (select *, unnest(range(x0, x1, step)) x from big) b, unnest(range(b.y0, b.y1, b.step)) u(y)),
 win as (select *, cast(floor(x*(cast(32 as double)/slide_w)) as bigint) wx, cast(floor(y*(cast(32 as double)/slide_h)) as bigint) wy, cast(greatest(1.0, round_even(tile*(cast(32 as double)/slide_w),0)) as bigint) ww, cast(greatest(1.0, round_even(tile*(cast(32 as double)/slide_h),0)) as bigint) wh from cand),
 sc as (select w.k, w.slide_id, w.contour_id, w.x, w.y, w.slide_w, w.slide_h, w.ww, w.wh, w.wx, w.wy, cast(cast(count(i.mx) as double)/any_value(ww*wh) as float) frac from win w left join inside i on i.k=w.k and i.component=w.contour_id and i.mx>=wx and i.mx<wx+ww and i.my>=wy and i.my<wy+wh group by all),
 kept as (select * from (select *, row_number() over (partition by k, x, y order by contour_id) n from sc where frac >= cast({limit} as float)) where n=1)"""
    )


ACTIVE = LABELLED.replace("with ", "with recursive ", 1) + ", act as (select *, coalesce(min_coverage, 0) least from vocabulary where annotation <> 'necrosis'), "
#: Each annotation by itself, and all on one set of grids.
ALONE = ACTIVE + "px as (select slide_id*4+value k, mx, my from lab join act using (annotation)), key as (select distinct slide_id, slide_id*4+value k from lab join act using (annotation)), " + contour_tiles(0.0) + ", own as (select k.slide_id, annotation, x, y, contour_id, frac from kept k join act on act.value=k.k%4 where frac >= cast(least as float))"
TOGETHER = (
    ACTIVE + "px as (select distinct slide_id k, mx, my from lab join act using (annotation)), key as (select slide_id, slide_id k from slides), " + contour_tiles(0.0)
    + ", hits as (select t.slide_id, annotation, least, t.x, t.y, cast(cast(count(l.mx) as double)/(ww*wh) as float) frac from (select * from kept cross join act) t left join lab l using (slide_id, annotation) where true group by t.slide_id, annotation, least, t.x, t.y, ww, wh)"
).replace("left join lab l using (slide_id, annotation) where true", "left join lab l on l.slide_id=t.slide_id and l.annotation=t.annotation and l.mx>=wx and l.mx<wx+ww and l.my>=wy and l.my<wy+wh").replace("select t.slide_id, annotation, least", "select t.slide_id, t.annotation, least").replace("group by t.slide_id, annotation", "group by t.slide_id, t.annotation")
TOGETHER += ", own as (select slide_id, annotation, x, y, frac from hits where frac >= cast(least as float))"
NUMBERED = "cast(row_number() over (partition by slide_id, annotation order by x, y)-1 as int) tile_index"
MERGED = "m as (select slide_id, x, y, max(frac) frac from own group by all) select slide_id, x, y, frac, cast(row_number() over (partition by slide_id order by x, y)-1 as int) tile_index from m"


def _annotated(f: Fixtures) -> tuple:
    from gridquarry.operators.levels import with_levels

    return sampling.split(f.label_px, f.vocabulary), with_levels(f.slides, f.pyramid), f.vocabulary.withColumn("active", F.col("annotation") != "necrosis"), SIDE, SIDE, SPEC


@query(ALONE + f" select slide_id, annotation, x, y, contour_id, frac, {NUMBERED} from own", "slides", "label_px", "vocabulary")
def independent_sampling(f: Fixtures) -> DataFrame:
    """Each active annotation on grids of its own contours."""
    return tiling.independent(*_annotated(f), block=BLOCK).select("slide_id", "annotation", "x", "y", "contour_id", "frac", "tile_index")


@query(TOGETHER + f" select slide_id, annotation, x, y, frac, {NUMBERED} from own", "slides", "label_px", "vocabulary")
def joint_sampling(f: Fixtures) -> DataFrame:
    """All active annotations on the grids of their common contours."""
    return tiling.joint(*_annotated(f), block=BLOCK).select("slide_id", "annotation", "x", "y", "frac", "tile_index")


@query(TOGETHER + ", " + MERGED, "slides", "label_px", "vocabulary")
def merged_sampling(f: Fixtures) -> DataFrame:
    return tiling.per_annotation(*_annotated(f), "joint", "merged", block=BLOCK).select("slide_id", "x", "y", "frac", "tile_index")


@query(ALONE + ", " + MERGED, "slides", "label_px", "vocabulary")
def merged_independent(f: Fixtures) -> DataFrame:
    return tiling.per_annotation(*_annotated(f), "independent", "merged", block=BLOCK).select("slide_id", "x", "y", "frac", "tile_index")


@query(PX + "key as (select slide_id, slide_id k from slides), " + contour_tiles(0.3) + " select slide_id, x, y, contour_id, frac, cast(row_number() over (partition by slide_id order by x, y)-1 as int) tile_index from kept", "slides", "mask_px")
def generate_tiles(f: Fixtures) -> DataFrame:
    """From masks to tiles: contours, a grid for each, coverage, first contour first, index."""
    from gridquarry.operators.levels import with_levels

    return tiling.from_mask(f.mask_px, with_levels(f.slides, f.pyramid), SIDE, SIDE, SPEC, block=BLOCK).select("slide_id", "x", "y", "contour_id", "frac", "tile_index")


#: Labels on every second pixel as well as on their own, so that some pixels have two.
DOUBLE = LABELLED + ", two as (select * from lab union select slide_id, 'stroma', mx, my from lab where (mx+my)%2=0)"


@query(DOUBLE + " select slide_id, mx, my, arg_max(v.value, v.place) label from two join vocabulary v using (annotation) group by all", "label_px", "vocabulary")
def combine_labels(f: Fixtures) -> DataFrame:
    own = sampling.split(f.label_px, f.vocabulary)
    return sampling.combined(own.union(own.where((F.col("mx") + F.col("my")) % 2 == 0).select("slide_id", F.lit("stroma").alias("annotation"), "mx", "my")).distinct(), f.vocabulary)


TILED = "with px as (select *, x//6 tx, y//6 ty, case when greatest(r,g,b)=0 then 0 else (510*(greatest(r,g,b)-least(r,g,b))+greatest(r,g,b))//(2*greatest(r,g,b)) end s, (299*r+587*g+114*b+500)//1000 v from rgb_px)"
TILE_KEYS = ["slide_id", "tx", "ty"]


def _tiled(f: Fixtures) -> DataFrame:
    return f.rgb_px.withColumn("tx", F.floor(F.col("x") / 6)).withColumn("ty", F.floor(F.col("y") / 6))


@query(TILED + " select slide_id, tx, ty, avg(case when r>150 and g>150 and b>150 then 1.0 else 0.0 end) white, avg(case when r>150 and g>150 and b>150 then 1.0 else 0.0 end) <= 0.1 keep from px group by all", "rgb_px")
def qc_white(f: Fixtures) -> DataFrame:
    return qc.shares(_tiled(f), TILE_KEYS, qc.Limits(white_above=150)).select(*TILE_KEYS, "white", (F.col("white") <= 0.1).alias("keep"))


@query(TILED + " select slide_id, tx, ty, avg(case when r<100 and g<100 and b<100 then 1.0 else 0.0 end) black, avg(case when r<100 and g<100 and b<100 then 1.0 else 0.0 end) <= 0.1 keep from px group by all", "rgb_px")
def qc_black(f: Fixtures) -> DataFrame:
    return qc.shares(_tiled(f), TILE_KEYS, qc.Limits(black_below=100)).select(*TILE_KEYS, "black", (F.col("black") <= 0.1).alias("keep"))


@query(TILED + " select slide_id, tx, ty, avg(case when s/255 < 0.3 then 1.0 else 0.0 end) grey, avg(case when s/255 < 0.3 then 1.0 else 0.0 end) <= 0.1 keep from px group by all", "rgb_px")
def qc_gray(f: Fixtures) -> DataFrame:
    return qc.shares(_tiled(f), TILE_KEYS, qc.Limits(grey_below=0.3)).select(*TILE_KEYS, "grey", (F.col("grey") <= 0.1).alias("keep"))


LAPLACE = (
    TILED
    + """, lap as (select slide_id, tx, ty, coalesce(lag(v) over a, lead(v) over a, v) + coalesce(lead(v) over a, lag(v) over a, v) + coalesce(lag(v) over d, lead(v) over d, v) + coalesce(lead(v) over d, lag(v) over d, v) - 4*v lap
 from px window a as (partition by slide_id, tx, ty, y order by x), d as (partition by slide_id, tx, ty, x order by y))"""
)


@query(LAPLACE + " select slide_id, tx, ty, round(var_pop(lap), 6) blur from lap group by all", "rgb_px")
def qc_blur(f: Fixtures) -> DataFrame:
    return qc.blur(_tiled(f), TILE_KEYS).select(*TILE_KEYS, F.round("blur", 6).alias("blur"))


KEEP = LAPLACE + (
    """, m as (select slide_id, tx, ty, avg(case when r>150 and g>150 and b>150 then 1.0 else 0.0 end) white, avg(case when r<100 and g<100 and b<100 then 1.0 else 0.0 end) black, avg(case when s/255 < 0.3 then 1.0 else 0.0 end) grey from px group by all),
 bl as (select slide_id, tx, ty, var_pop(lap) blur from lap group by all), q as (select slide_id, tx, ty, white <= 0.2 and black <= 0.2 and grey <= 0.3 and blur >= 15000 keep from m join bl using (slide_id, tx, ty))"""
)
LIMITS = qc.Limits(white_above=150, white_share=0.2, black_below=100, black_share=0.2, grey_below=0.3, grey_share=0.3, blur_least=15000)


@query(KEEP + " select slide_id, tx, ty, keep from q", "rgb_px")
def tile_qc(f: Fixtures) -> DataFrame:
    return qc.checked(_tiled(f), TILE_KEYS, LIMITS).select(*TILE_KEYS, "keep")


@query(KEEP + " select slide_id, tx x, ty y, cast(row_number() over (partition by slide_id order by tx, ty) - 1 as int) tile_index from q where keep", "rgb_px")
def qc_reindex(f: Fixtures) -> DataFrame:
    from gridquarry.operators.grid import indexed

    kept = qc.checked(_tiled(f), TILE_KEYS, LIMITS).where("keep")
    tiles = _tiled(f).select("slide_id", F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()
    semi = tiles.join(kept.select("slide_id", F.col("tx").alias("x"), F.col("ty").alias("y")), ["slide_id", "x", "y"], "left_semi")
    return indexed(semi, ["slide_id"]).select("slide_id", "x", "y", "tile_index")


@query(CANDIDATES + "select slide_id, tile_index, x // 1024 bx, y // 1024 by_ from tiles", "slides", "mask_px")
def qc_batches(f: Fixtures) -> DataFrame:
    return qc.batches(f.tiles, 128).select("slide_id", "tile_index", "bx", F.col("by").alias("by_"))


HSV = """with px as (select *, greatest(r,g,b) mx, greatest(r,g,b)-least(r,g,b) d from rgb_px),
 hh as (select *, case when d=0 then 0 when mx=r then 60.0*(g-b)/d when mx=g then 120.0+60.0*(b-r)/d else 240.0+60.0*(r-g)/d end deg from px),
 q as (select slide_id, x, y, cast(floor((case when deg<0 then deg+360 else deg end)/2+0.5) as int)%180 h, case when mx=0 then 0 else cast((510*d+mx)//(2*mx) as int) end s, mx v from hh)"""


@query(HSV + " select slide_id, x, y, h between 90 and 180 and s between 8 and 255 and v between 103 and 255 tissue from q", "rgb_px")
def seg_hsv(f: Fixtures) -> DataFrame:
    return seg.hsv_range(f.rgb_px).select("slide_id", "x", "y", "tissue")


def median_of(radius: int) -> str:
    """med(slide_id, x, y, median) for DuckDB: saturation's middle in squares, the edge repeated."""
    reach = f"unnest([{','.join(str(d) for d in range(-radius, radius + 1))}])"
    middle = ((2 * radius + 1) ** 2 + 1) // 2
    return HSV + f", e as (select slide_id, max(x) ex, max(y) ey from q group by 1), n as (select q.slide_id, q.x, q.y, least(greatest(q.x+dx,0),ex) nx, least(greatest(q.y+dy,0),ey) ny from q join e using (slide_id), {reach} a(dx), {reach} b(dy)), med as (select n.slide_id, n.x, n.y, list_sort(list(q.s))[{middle}] median from n join q on q.slide_id=n.slide_id and q.x=n.nx and q.y=n.ny group by all)"


MEDIAN = median_of(1)


def closed_by(source: str, before: int, after: int) -> str:
    """closed(slide_id, mx, my, v) for DuckDB: source(slide_id, mx, my, v) dilated and eroded by a square."""
    parts, last = [], source
    for k, (fn, line, order) in enumerate((("max", "my", "mx"), ("max", "mx", "my"), ("min", "my", "mx"), ("min", "mx", "my"))):
        name = "closed" if k == 3 else f"cl{k}"
        parts.append(f"{name} as (select slide_id, mx, my, {fn}(v) over (partition by slide_id, {line} order by {order} rows between {before} preceding and {after} following) v from {last})")
        last = name
    return ", ".join(parts)


@query(MEDIAN + " select slide_id, x, y, median from med", "rgb_px")
def median_blur(f: Fixtures) -> DataFrame:
    return seg.median(seg.with_saturation(f.rgb_px), "s")


@query(MEDIAN + " select slide_id, x, y, median > 150 tissue from med", "rgb_px")
def seg_threshold(f: Fixtures) -> DataFrame:
    return seg.threshold(seg.median(seg.with_saturation(f.rgb_px), "s"), "median", 150).select("slide_id", "x", "y", "tissue")


OTSU = """, b as (select slide_id, median v, count(*) n from med group by all), c as (select slide_id, v, sum(n) over w n0, sum(v*n) over w s0, sum(n) over (partition by slide_id) n1, sum(v*n) over (partition by slide_id) s1 from b window w as (partition by slide_id order by v)),
 z as (select slide_id, v, case when n0<n1 then cast(s0*n1-s1*n0 as double)*cast(s0*n1-s1*n0 as double)/cast(n0*(n1-n0) as double) else 0 end bt from c), r as (select *, row_number() over (partition by slide_id order by bt desc, v) k from z)"""


@query(MEDIAN + OTSU + " select slide_id, v threshold from r where k=1", "rgb_px")
def seg_otsu(f: Fixtures) -> DataFrame:
    return seg.otsu(seg.median(seg.with_saturation(f.rgb_px), "s"), "median")


PREPROCESS = (
    MEDIAN.replace("with px as", "with recursive hp as", 1).replace("from px)", "from hp)")
    + ", tissue as (select slide_id, x mx, y my, cast(median > 60 as int) v from med), " + closed_by("tissue", 1, 1)
    + ", px as (select slide_id k, mx, my from closed where v=1 and slide_id%3<>0 union all select slide_id, mx, my from label_px where slide_id%3=0 and label=2), key as (select slide_id, slide_id k from slides), "
)


@query(PREPROCESS + contour_tiles(0.3) + " select slide_id, cast(row_number() over (partition by slide_id order by x, y)-1 as int) tile_index, x, y, contour_id, frac, cast(round_even(256*cast(0.5 as double)/base_spacing_um,0) as bigint) tile from kept join slides using (slide_id)", "slides", "rgb_px", "label_px")
def preprocess_slides(f: Fixtures) -> DataFrame:
    """From thumbnails to tiles: segmentation by colour, a mask for every slide, contours, grids, coverage, index."""
    from gridquarry.operators.levels import with_levels

    slides = f.slides.withColumn("mask_path", F.when(F.col("slide_id") % 3 == 0, F.col("sample_id")))
    mask, _ = tiling.resolve_mask(slides, f.label_px.withColumnRenamed("label", "value"), seg.segmented(f.rgb_px, "threshold", 60, 1, 3), 2)
    return tiling.from_mask(mask, with_levels(f.slides, f.pyramid), SIDE, SIDE, SPEC, block=BLOCK)


DENSE = "with dn as (select a.slide_id, a.mx, u.my, case when m.mx is null then 0 else 1 end v from (select slide_id, unnest(range(0,32)) mx from slides) a cross join unnest(range(0,32)) u(my) left join mask_px m on m.slide_id=a.slide_id and m.mx=a.mx and m.my=u.my)"


def _dense(f: Fixtures) -> DataFrame:
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SIDE - 1).cast("bigint"))).alias(c)
    dense = f.slides.select("slide_id", axis("mx")).select("slide_id", "mx", axis("my"))
    return dense.join(f.mask_px.withColumn("v", F.lit(1)), ["slide_id", "mx", "my"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


@query(
    DENSE
    + """, a as (select slide_id, mx, my, max(v) over (partition by slide_id, my order by mx rows between 1 preceding and 1 following) v from dn), b as (select slide_id, mx, my, max(v) over (partition by slide_id, mx order by my rows between 1 preceding and 1 following) v from a),
 c as (select slide_id, mx, my, min(v) over (partition by slide_id, my order by mx rows between 1 preceding and 1 following) v from b) select slide_id, mx, my, min(v) over (partition by slide_id, mx order by my rows between 1 preceding and 1 following) v from c""",
    "slides",
    "mask_px",
)
def morph_close(f: Fixtures) -> DataFrame:
    return seg.closed(_dense(f)).select("slide_id", "mx", "my", "v")


@query("select slide_id, cast(mx*2+dx as bigint) mx, cast(my*2+dy as bigint) my, label from label_px, unnest([0,1]) a(dx), unnest([0,1]) b(dy)", "label_px")
def label_resample_nearest(f: Fixtures) -> DataFrame:
    return seg.resampled(f.label_px, 2)


def _resized(width: int) -> str:
    return f"select l.slide_id, d.p mx, e.p my, label from label_px l join (select unnest(range(0,{width})) p) d on (d.p*32)//{width}=l.mx join (select unnest(range(0,{width})) p) e on (e.p*32)//{width}=l.my"


@query(_resized(80), "label_px")
def label_upsample(f: Fixtures) -> DataFrame:
    return seg.resized_labels(f.label_px, (SIDE, SIDE), (80, 80))


@query(_resized(12), "label_px")
def label_downsample(f: Fixtures) -> DataFrame:
    return seg.resized_labels(f.label_px, (SIDE, SIDE), (12, 12))


@query("select slide_id, count(distinct r) n_values, bool_and(r=floor(r)) whole, bool_and(r=g and g=b) one_channel, count(distinct r) <= 2 binary_like from (select slide_id, x, y, case when slide_id%2=0 then r%2 else r end r, case when slide_id%2=0 then r%2 else g end g, case when slide_id%2=0 then r%2 else b end b from rgb_px) group by 1", "rgb_px")
def discreteness(f: Fixtures) -> DataFrame:
    """Whether the rasters may be label images; every second one is made so."""
    even = F.col("slide_id") % 2 == 0
    return seg.discreteness(f.rgb_px.select("slide_id", "x", "y", *(F.when(even, F.col("r") % 2).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b"))))


COLOURS = [(1, (255, 0, 0)), (2, (0, 128, 255))]
MIXED = "select p.slide_id, p.x, p.y, " + ", ".join(f"cast(case when m.alpha > 0 then round_even({c}*(1.0-m.alpha)+{m}*m.alpha, 0) else {c} end as int) {c}" for c, m in (("r", "mr"), ("g", "mg"), ("b", "mb"))) + " from rgb_px p left join marks m on m.slide_id=p.slide_id and m.x=p.x and m.y=p.y"
PAINT = "case label when 1 then 255 else 0 end mr, case label when 2 then 128 else 0 end mg, case label when 2 then 255 else 0 end mb"


def _colours(f: Fixtures) -> DataFrame:
    from gridquarry.operators.labels import palette

    return palette(f.spark.createDataFrame(COLOURS, "value int, color array<int>"))


def _shown(f: Fixtures) -> DataFrame:
    return f.label_px.select("slide_id", F.col("mx").alias("x"), F.col("my").alias("y"), "label")


@query(f"with marks as (select slide_id, mx x, my y, {PAINT}, case when label=3 then 0.0 else 0.25 end alpha from label_px) {MIXED}", "rgb_px", "label_px")
def overlay_preview(f: Fixtures) -> DataFrame:
    """Labels over thumbnails, see-through; label 3 is hidden."""
    return rendering.mask_preview(f.rgb_px, _shown(f), _colours(f), True, 0.25, 3)


OUTLINE = "outl as (select l.* from label_px l where (select count(*) from label_px o where o.slide_id=l.slide_id and o.label=l.label and abs(o.mx-l.mx)+abs(o.my-l.my)=1) < 4)"


@query(f"with {OUTLINE}, marks as (select slide_id, mx x, my y, {PAINT}, 1.0 alpha from outl) {MIXED}", "rgb_px", "label_px")
def outline_preview(f: Fixtures) -> DataFrame:
    """Labels' outlines over thumbnails."""
    return rendering.mask_preview(f.rgb_px, _shown(f), _colours(f))


@query(
    CANDIDATES
    + f""", rect as (select slide_id, cast(ceil(x/48.0) as bigint) x0, cast(ceil(y/48.0) as bigint) y0, cast(ceil((x+128)/48.0) as bigint) x1, cast(ceil((y+128)/48.0) as bigint) y1 from tiles),
 spots as (select slide_id, unnest(range(x0, x1+1)) x, y0, y1, null x0, null x1 from rect union all select slide_id, null, null, null, x0, x1 from rect where false),
 lines as (select slide_id, x, y0 y from spots union select slide_id, x, y1 from spots union select slide_id, x0, unnest(range(y0, y1+1)) from rect union select slide_id, x1, unnest(range(y0, y1+1)) from rect),
 marks as (select slide_id, x, y, 0 mr, 0 mg, 0 mb, 1.0 alpha from lines where x < 32 and y < 32) {MIXED} where p.slide_id in (select slide_id from tiles)""",
    "slides",
    "mask_px",
    "rgb_px",
)
def grid_preview(f: Fixtures) -> DataFrame:
    """Outlines of tiles over thumbnails."""
    return rendering.tiling_preview(f.rgb_px, f.tiles.withColumn("tile", F.lit(128)), 48.0, SIDE, SIDE)


@query()
def preview_images(f: Fixtures) -> DataFrame:
    """The same as one PNG for each slide."""
    return rendering.images(grid_preview(f)).select("slide_id", "width", "height", F.length("image").alias("n_bytes"), F.sha2("image", 256).alias("digest"))


#: A thresholded smooth colour range and its clean-up.
@query()
def tissue_masks(f: Fixtures) -> DataFrame:
    """Colour range of smoothed pixels, small components and holes away, closing and opening with ellipses."""
    return seg.postprocessed(seg.fine_mask(f.rgb_px, 1.0, block=BLOCK), SIDE, SIDE, 4, 3, 1, 1, BLOCK)


#: Every second pixel's colour finds boxes with a margin of two pixels; the fine raster counts inside them.
COARSE = (
    HSV.replace("with px as", "with recursive hp as", 1).replace("from px)", "from hp)")
    + ", t as (select slide_id, x, y, h between 90 and 180 and s between 8 and 255 and v between 103 and 255 tissue from q), px as (select slide_id k, x//2 mx, y//2 my from t where tissue and x%2=0 and y%2=0), "
    + walk("fg", "px")
    + ", bx as (select k, component, greatest(min(mx)*2-2, 0) x0, greatest(min(my)*2-2, 0) y0, least((max(mx)+1)*2+2, 32) x1, least((max(my)+1)*2+2, 32) y1 from fg group by all), fine as (select distinct t.slide_id, t.x, t.y from t join bx on bx.k=t.slide_id and x>=x0 and x<x1 and y>=y0 and y<y1 where tissue)"
)


@query(COARSE + " select t.slide_id, t.x, t.y, cast(fine.x is not null as int) v from t left join fine using (slide_id, x, y)", "rgb_px")
def coarse_masks(f: Fixtures) -> DataFrame:
    """Every second pixel finds boxes of tissue; the full raster is judged in those."""
    return seg.coarse_to_fine(f.rgb_px, 2, 2, SIDE, SIDE, block=BLOCK)


@query(median_of(3) + OTSU + ", tissue as (select slide_id, x mx, y my, cast(median > r.v as int) v from med join r using (slide_id) where r.k=1), " + closed_by("tissue", 2, 1) + " select slide_id, mx, my from closed where v=1", "rgb_px")
def segmented_masks(f: Fixtures) -> DataFrame:
    """Otsu over a median of side 7, closed with a square of side 4, as by default."""
    return seg.segmented(f.rgb_px, "otsu", block=BLOCK)


@query("select l.slide_id, t.mx, t.my from label_px l join (select slide_id, mx, my from mask_px) t on t.slide_id=l.slide_id and cast(floor(t.mx/cast(2 as double)) as bigint)=l.mx and cast(floor(t.my/cast(2 as double)) as bigint)=l.my where l.label=1", "label_px", "mask_px")
def aligned_mask(f: Fixtures) -> DataFrame:
    """Mask pixels whose place on the half-size label raster is label 1."""
    halved = f.mask_px.select("slide_id", "mx", "my", F.floor(F.col("mx") / 2).alias("lx"), F.floor(F.col("my") / 2).alias("ly"))
    label = f.label_px.where("label = 1").select("slide_id", F.col("mx").alias("lx"), F.col("my").alias("ly"))
    return halved.join(label, ["slide_id", "lx", "ly"]).select("slide_id", "mx", "my")


@query("select slide_id, mx, my, 255 value from label_px where label=2", "label_px")
def tissue_mask_binarize(f: Fixtures) -> DataFrame:
    return f.label_px.where(F.col("label") == 2).select("slide_id", "mx", "my", F.lit(255).alias("value"))


@query("select 0 level, slide_id, mx, my from mask_px union all select 1, slide_id, mx//2, my//2 from mask_px where mx%2=0 and my%2=0 union all select 2, slide_id, mx//4, my//4 from mask_px where mx%4=0 and my%4=0", "mask_px")
def mask_pyramid(f: Fixtures) -> DataFrame:
    return seg.mask_pyramid(f.mask_px, SIDE, 8)


def _labelled(f: Fixtures) -> DataFrame:
    return cc.components(f.mask_px, SIDE, BLOCK)


@query(REACH + " select slide_id, mx, my, component from comp", "mask_px")
def contour_components(f: Fixtures) -> DataFrame:
    return _labelled(f)


@query(REACH + " select c.slide_id, mx, my, component from comp c join ar using (slide_id, component) where area >= 4", "mask_px")
def remove_small_components(f: Fixtures) -> DataFrame:
    return cc.without_small(_labelled(f), 4).select("slide_id", "mx", "my", "component")


@query(REACH + " select slide_id, component, cast(greatest(x0*4-2,0) as bigint) x0, cast(greatest(y0*4-2,0) as bigint) y0, cast(least((x1+1)*4+2,128) as bigint) x1, cast(least((y1+1)*4+2,128) as bigint) y1 from ar", "mask_px")
def roi_boxes(f: Fixtures) -> DataFrame:
    return cc.roi_boxes(_labelled(f), 4, 2, 128)


@query(
    REACH
    + ", bx as (select slide_id, component, x0*4-10 x0, y0*4-10 y0, (x1+1)*4+10 x1, (y1+1)*4+10 y1 from ar), b as (select slide_id, component, greatest(x0,0) x0, greatest(y0,0) y0, least(x1,128) x1, least(y1,128) y1 from bx) select a.slide_id, a.component, o.component other from b a join b o on a.slide_id=o.slide_id and a.component<o.component and a.x0<o.x1 and o.x0<a.x1 and a.y0<o.y1 and o.y0<a.y1",
    "mask_px",
)
def roi_overlaps(f: Fixtures) -> DataFrame:
    return cc.overlapping(cc.roi_boxes(_labelled(f), 4, 10, 128))


@query(REACH + ", " + SQUARES + " select k slide_id, component, area from tr", "mask_px")
def contour_area(f: Fixtures) -> DataFrame:
    """Area inside the outer contour of each component, less those of its holes."""
    return cc.traced_areas(_labelled(f))


@query(REACH + " select slide_id, component, area, cast(row_number() over (partition by slide_id order by area desc, component) as int) rank from ar", "mask_px")
def component_rank(f: Fixtures) -> DataFrame:
    return cc.by_size(_labelled(f)).select("slide_id", "component", "area", "rank")


@query(PX + BACK + ", " + walk("back", "back_px") + ", " + INNER + " select k slide_id, mx, my from px union select b.k, b.mx, b.my from back b join inn using (k, component) where area <= 3", "mask_px")
def fill_small_holes(f: Fixtures) -> DataFrame:
    return cc.filled(f.mask_px, f.mask_px.select("slide_id").distinct(), SIDE, SIDE, 3, BLOCK)


def _holes(four: bool) -> str:
    return (
        PX + walk("fg", "px") + ", " + BACK + ", " + walk("back", "back_px", four) + ", " + INNER
        + ", fst as (select b.k, component hole, any_value(area) area, min(my*32+mx) p from back b join inn using (k, component) group by all) select f.k slide_id, f.hole, f.area, fg.component parent from fst f join fg on fg.k=f.k and fg.my=f.p//32 and fg.mx=f.p%32-1"
    )


@query(_holes(False), "mask_px")
def contour_holes(f: Fixtures) -> DataFrame:
    """Pieces of background that hang together by eight neighbours, as filled by size, and the component around each."""
    return cc.hole_parents(cc.holes(f.mask_px, f.mask_px.select("slide_id").distinct(), SIDE, SIDE, block=BLOCK), _labelled(f))


@query(_holes(True), "mask_px")
def contour_hierarchy(f: Fixtures) -> DataFrame:
    """Holes of contours: pieces of background that hang together by four neighbours, and the contour around each."""
    return cc.hole_parents(cc.holes(f.mask_px, f.mask_px.select("slide_id").distinct(), SIDE, SIDE, connectivity=4, block=BLOCK), _labelled(f))


#: Names of an earlier round, when the plain names did a part of this.
for _name in ("qc_white", "qc_black", "qc_gray", "qc_blur", "tile_qc", "qc_reindex", "seg_hsv", "median_blur", "seg_threshold", "seg_otsu", "contour_components", "remove_small_components", "roi_boxes", "roi_overlaps", "contour_area", "component_rank", "fill_small_holes", "contour_holes"):
    again(_name, "_whole")


BLOCKS = CANDIDATES + (
    """, k as (select *, x//96 kx, y//96 ky from tiles), e as (select slide_id, kx//8 cx, ky//8 cy from k group by all having count(*)=64), a8 as (select k.*, e.cx is not null in8 from k left join e on e.slide_id=k.slide_id and e.cx=k.kx//8 and e.cy=k.ky//8),
 q as (select slide_id, kx//4 cx, ky//4 cy from a8 where not in8 group by all having count(*)=16), a4 as (select a8.*, q.cx is not null and not in8 in4 from a8 left join q on q.slide_id=a8.slide_id and q.cx=kx//4 and q.cy=ky//4),
 d as (select slide_id, kx//2 cx, ky//2 cy from a4 where not in8 and not in4 group by all having count(*)=4), a2 as (select a4.*, d.cx is not null and not in8 and not in4 in2 from a4 left join d on d.slide_id=a4.slide_id and d.cx=kx//2 and d.cy=ky//2),
 s as (select *, case when in8 then 8 when in4 then 4 when in2 then 2 else 1 end block_size from a2), bl as (select slide_id, tile_index, x, y, block_size, (kx//block_size)*block_size*96 ax, (ky//block_size)*block_size*96 ay from s)"""
)


def _blocked(f: Fixtures) -> DataFrame:
    return supertiles.aligned_blocks(f.tiles, 96)


@query(BLOCKS + " select slide_id, tile_index, x, y, block_size, ax, ay from bl", "slides", "mask_px")
def supertile_dense_blocks(f: Fixtures) -> DataFrame:
    return _blocked(f).select("slide_id", "tile_index", "x", "y", "block_size", "ax", "ay")


@query(BLOCKS + ", p as (select *, cast(row_number() over (partition by slide_id order by block_size desc, ax, ay)-1 as int) st_id from (select distinct slide_id, block_size, ax, ay from bl)) select slide_id, tile_index, st_id, cast((x-ax)//96*48 as int) crop_x, cast((y-ay)//96*48 as int) crop_y from bl join p using (slide_id, block_size, ax, ay)", "slides", "mask_px")
def supertile_index(f: Fixtures) -> DataFrame:
    return supertiles.index(_blocked(f), 96, 48).select("slide_id", "tile_index", "st_id", "crop_x", "crop_y")


PLANS = BLOCKS + ", pl as (select slide_id, block_size, ax, ay, count(*) n_tiles, cast(64+(block_size-1)*48 as bigint) read_size_px from bl group by all)"


@query(PLANS + " select slide_id, read_size_px, count(*) n_plans, cast(sum(n_tiles) as bigint) n_tiles from pl group by all", "slides", "mask_px")
def group_plans(f: Fixtures) -> DataFrame:
    return supertiles.grouped(supertiles.plans(_blocked(f), 64, 48))


@query(PLANS + " select slide_id, block_size, ax, ay, cast(i*block_size+j as int) pos, ax+i*96 x, ay+j*96 y, cast(i*48 as int) crop_x, cast(j*48 as int) crop_y from (select *, unnest(range(0, block_size)) i from pl) p, unnest(range(0, p.block_size)) u(j)", "slides", "mask_px")
def region_slices(f: Fixtures) -> DataFrame:
    return supertiles.regions(supertiles.plans(_blocked(f), 64, 48), 96, 48)


@query()
def supertile_greedy(f: Fixtures) -> DataFrame:
    return supertiles.greedy(f.tiles, 96)


@query(REACH + ", " + SQUARES + " select k slide_id, component, area from tr", "mask_px")
def outline_areas(f: Fixtures) -> DataFrame:
    """Areas of contours from the points of their followed borders, holes taken off."""
    return outlines.net_areas(outlines.contours(outlines.sides(_labelled(f), SIDE, SIDE, block=BLOCK))).select("slide_id", "component", "area")


@query(PX + BACK + ", " + walk("back", "back_px", True) + ", " + walk("fg", "px") + ", " + INNER + " select b.k slide_id, b.mx, b.my from back b join inn using (k, component) union select k, mx, my from px", "mask_px")
def outline_fill(f: Fixtures) -> DataFrame:
    """Pixels that the outer contours enclose, line by line."""
    runs = outlines.filled(outlines.sides(_labelled(f), SIDE, SIDE, block=BLOCK))
    return runs.select("slide_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("mx"), F.col("y").alias("my")).distinct()

"""Queries on manifests, runs, labels, metadata and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.functions import names
from gridquarry.operators import labels, preview, provenance, runs
from gridquarry.plans.fixtures import CANDIDATES, Fixtures
from gridquarry.plans.registry import query
from gridquarry.sources import manifest as mf

MASK = "case when lower(trim(raw_mask_path)) in ('', 'none', 'nan') then null else trim(raw_mask_path) end"


@query(f"select sample_id, image_path, {MASK} mask_path, override_um spacing_at_level_0 from manifest", "manifest")
def manifest_scan(f: Fixtures) -> DataFrame:
    return mf.slides(f.manifest.withColumnRenamed("raw_mask_path", "mask_path").withColumnRenamed("override_um", "spacing_at_level_0"))


@query(f"select sample_id, {MASK} mask_path from manifest", "manifest")
def optional_path(f: Fixtures) -> DataFrame:
    return f.manifest.select("sample_id", names.optional_path(F.col("raw_mask_path")).alias("mask_path"))


@query("select distinct sample_id, image_path, mask_path from rows", "rows")
def manifest_from_process_list(f: Fixtures) -> DataFrame:
    return mf.from_process_list(f.rows)


@query("select sample_id, count(*) n from rows group by 1 having count(*)>1", "rows")
def duplicate_ids(f: Fixtures) -> DataFrame:
    return runs.duplicate_ids(f.rows)


BACKEND = "ranked as (select image_path, candidate, row_number() over (partition by image_path order by case candidate when 'cucim' then 1 when 'vips' then 2 when 'openslide' then 3 else 4 end) k from openable)"
CHOICE = "case when lower(regexp_extract(m.image_path, '(\\.[^./]+)$', 1)) in ('.png','.jpg','.jpeg') then 'pil' else r.candidate end"


@query(f"with {BACKEND} select m.sample_id, m.image_path, {CHOICE} backend from manifest m left join ranked r on r.image_path=m.image_path and r.k=1", "manifest", "openable")
def resolve_backend(f: Fixtures) -> DataFrame:
    return runs.resolve_backend(f.manifest, f.openable).select("sample_id", "image_path", "backend")


@query(f"with {BACKEND} select m.sample_id, {CHOICE} backend, case when {MASK} is not null then 'vips' end mask_backend from manifest m left join ranked r on r.image_path=m.image_path and r.k=1", "manifest", "openable")
def resolve_backends(f: Fixtures) -> DataFrame:
    """Slide and mask are resolved independently; without a mask there is no mask backend."""
    masks = f.manifest.select("sample_id", "image_path", names.optional_path(F.col("raw_mask_path")).alias("mask_path"))
    can = masks.select("mask_path", F.lit("vips").alias("candidate")).where("mask_path is not null").distinct()
    return runs.resolve_backend(runs.resolve_backend(masks, f.openable), can, "mask_path", "mask_backend").select("sample_id", "backend", "mask_backend")


STATUS = "case when tiling_status='success' then null else coalesce(nullif(trim(error),''),'unknown error') end"


@query(
    """with o as (select sample_id, annotation, num_tiles, case when row_id%3=0 then 'bad' end error, row_id from rows), s as (select sample_id, image_path from manifest)
 select o.sample_id, o.annotation, s.image_path, case when error is null then 'success' else 'failed' end tiling_status, case when error is null then num_tiles else 0 end num_tiles,
 case when error is null and num_tiles>0 then (case when annotation is null or annotation='tissue' then o.sample_id else annotation||'/'||o.sample_id end)||'.coordinates.npz' end coordinates_npz_path,
 case when error is null then (case when annotation is null or annotation='tissue' then o.sample_id else annotation||'/'||o.sample_id end)||'.coordinates.meta.json' end coordinates_meta_path, error from o join s using (sample_id)""",
    "rows",
    "manifest",
)
def process_list(f: Fixtures) -> DataFrame:
    outcome = f.rows.select("sample_id", "annotation", "num_tiles", F.when(F.col("row_id") % 3 == 0, F.lit("bad")).alias("error"))
    return runs.process_rows(f.manifest.select("sample_id", "image_path"), outcome)


LAST = "last_ as (select * from (select *, row_number() over (partition by sample_id order by row_id desc) k from rows where tiling_status='success') where k=1)"


@query(f"with {LAST} select sample_id, row_id, num_tiles, image_path from last_", "rows")
def resume_scan(f: Fixtures) -> DataFrame:
    return runs.latest_successes(f.rows).select("sample_id", "row_id", "num_tiles", "image_path")


NOW = "cur as (select sample_id, image_path, case when row_id%2=0 then '/mask/1.tif' end mask_path, 'vips' backend, case when row_id%2=0 then 'vips' end mask_backend from manifest)"


def _current(f: Fixtures) -> DataFrame:
    even = F.col("row_id") % 2 == 0
    return f.manifest.select("sample_id", "image_path", F.when(even, F.lit("/mask/1.tif")).alias("mask_path"), F.lit("vips").alias("backend"), F.when(even, F.lit("vips")).alias("mask_backend"))


@query(
    f"with {LAST}, {NOW} select c.sample_id, case when l.sample_id is null then 'new' when c.image_path is distinct from l.image_path then 'image_path' when c.mask_path is distinct from l.mask_path then 'mask_path' when c.backend is distinct from l.backend then 'backend' when c.mask_backend is distinct from l.mask_backend then 'mask_backend' else 'ok' end first_mismatch from cur c left join last_ l using (sample_id)",
    "rows",
    "manifest",
)
def resume_validation(f: Fixtures) -> DataFrame:
    return runs.validated(_current(f), runs.latest_successes(f.rows)).select("sample_id", "first_mismatch")


@query(f"with {LAST}, {NOW} select c.sample_id, coalesce(c.mask_path, l.mask_path) mask_path, coalesce(c.mask_backend, l.mask_backend) mask_backend from cur c left join last_ l using (sample_id)", "rows", "manifest")
def resume_merge(f: Fixtures) -> DataFrame:
    return runs.merged_metadata(_current(f), runs.latest_successes(f.rows), ("mask_path", "mask_backend"))


@query("select sample_id, image_path from manifest m where not exists (select 1 from rows r where r.sample_id=m.sample_id and r.tiling_status='failed')", "rows", "manifest")
def mask_failure_antijoin(f: Fixtures) -> DataFrame:
    return runs.without_failures(f.manifest, f.rows.where("tiling_status = 'failed'")).select("sample_id", "image_path")


@query("with p as (select sample_id, min(row_id) input_index from manifest group by 1) select r.row_id, r.sample_id, p.input_index, row_number() over (order by p.input_index, r.annotation nulls first, r.row_id) - 1 out_index from rows r join p using (sample_id)", "rows", "manifest")
def input_order(f: Fixtures) -> DataFrame:
    return runs.input_order(f.rows, f.manifest, ("annotation", "row_id")).select("row_id", "sample_id", "input_index", "out_index")


@query("with d as (select sample_id, coalesce(nullif(trim(error),''),'unknown error') reason, min(row_id) at_ from rows where tiling_status='failed' group by all) select sample_id, string_agg(reason, ' | ' order by at_) reasons from d group by 1", "rows")
def failed_slides(f: Fixtures) -> DataFrame:
    return runs.failed_slides(f.rows)


@query("select count(*) filter (where tiling_status='success') completed, count(*) filter (where tiling_status='failed') failed, count(*) filter (where tiling_status not in ('success','failed')) pending, count(*) filter (where tiling_status='success' and num_tiles=0) zero_tile, cast(coalesce(sum(num_tiles) filter (where tiling_status='success'),0) as bigint) discovered_tiles from rows", "rows")
def progress_snapshot(f: Fixtures) -> DataFrame:
    return runs.progress(f.rows)


TOLD = "with told as (select slide_id, mx, my, label from label_px where slide_id%3=0 and label=2), m as (select slide_id, mx, my from told union all select slide_id, mx, my from mask_px where slide_id%3<>0), n as (select s.slide_id, case when s.slide_id%3=0 then 'precomputed' else 'segmented' end tissue_method, count(m.mx) n_px from slides s left join m using (slide_id) group by all)"


def _resolved(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """A mask file for every third slide, whose label 2 is tissue; the others are segmented."""
    from gridquarry.operators.tiling import resolve_mask

    slides = f.slides.withColumn("mask_path", F.when(F.col("slide_id") % 3 == 0, F.concat(F.lit("/mask/"), "sample_id")))
    return resolve_mask(slides, f.label_px.withColumnRenamed("label", "value"), f.mask_px, 2)


@query(TOLD + " select slide_id, mx, my from m", "slides", "mask_px", "label_px")
def resolved_masks(f: Fixtures) -> DataFrame:
    return _resolved(f)[0]


@query(TOLD + " select slide_id, tissue_method, n_px, n_px=0 is_empty from n", "slides", "mask_px", "label_px")
def mask_provenance(f: Fixtures) -> DataFrame:
    return _resolved(f)[1]


@query(TOLD + " select count(*) filter (where n_px=0 and tissue_method='precomputed') n_empty from n", "slides", "mask_px", "label_px")
def empty_masks(f: Fixtures) -> DataFrame:
    """How many mask files turned out empty."""
    return _resolved(f)[1].agg(F.count_if(F.col("is_empty") & (F.col("tissue_method") == "precomputed")).alias("n_empty"))


@query("select slide_id, greatest(1, least(8, slide_id)) outer_, cast(greatest(1, floor(8.0/greatest(1, least(8, slide_id)))) as int) inner_ from slides", "slides")
def worker_allocation(f: Fixtures) -> DataFrame:
    outer, inner = runs.worker_allocation(8, F.col("slide_id"))
    return f.slides.select("slide_id", outer.alias("outer_"), inner.alias("inner_"))


@query("select sample_id, annotation, cast(sum(num_tiles) as bigint) num_tiles from rows group by rollup(sample_id, annotation)", "rows")
def tile_rollup(f: Fixtures) -> DataFrame:
    return runs.tile_rollup(f.rows)


SIGNED = "sg as (select sample_id, image_path, row_id, sha256(sample_id||'|'||image_path||'|'||cast(row_id as varchar)) signature from manifest)"


@query(f"with {SIGNED} select sample_id, signature from sg where row_id%3<>0", "manifest")
def cache_skip(f: Fixtures) -> DataFrame:
    jobs = f.manifest.withColumn("size", F.col("row_id"))
    done = jobs.where(F.col("row_id") % 3 == 0).select(F.sha2(F.concat_ws("|", "sample_id", "image_path", F.col("size").cast("string")), 256).alias("signature"))
    return runs.cache_skip(jobs, done).select("sample_id", "signature")


@query("select sample_id, '/out/'||replace(regexp_extract(image_path,'([^/]+)\\.[^.]+$',1),' ','_')||'.tif' output_path, count(*) over (partition by regexp_extract(image_path,'([^/]+)\\.[^.]+$',1)) > 1 clash from manifest", "manifest")
def output_mapping(f: Fixtures) -> DataFrame:
    stem = F.replace(F.regexp_extract("image_path", r"([^/]+)\.[^.]+$", 1), F.lit(" "), F.lit("_"))
    named = f.manifest.select("sample_id", F.concat(F.lit("/out/"), stem, F.lit(".tif")).alias("output_path"))
    counts = named.groupBy("output_path").agg(F.count(F.lit(1)).alias("n"))
    return named.join(counts, "output_path").select("sample_id", "output_path", (F.col("n") > 1).alias("clash"))


#: Settings of a slide and those stored with its tiles: text, numbers and flags made by rule, one setting changed in each remainder.
KINDS = dict.fromkeys(("image_path", "mask_path", "backend", "mask_backend", "tissue_method", "sam2_checkpoint_path", "sam2_config_path", "selection_strategy", "output_mode", "annotation"), "varchar(20)") | dict.fromkeys(("filter_white", "filter_black", "filter_grayspace", "filter_blur"), "boolean")


def _setting(name: str, place: int, stored: bool) -> str:
    kind = KINDS.get(name, "double")
    base = {"varchar(20)": f"'{name[:8]}'", "boolean": f"c_custkey%{place % 3 + 2}=0", "double": f"cast({place}.5 as double)"}[kind]
    if name == "tissue_method":
        base = "case when c_custkey%5=0 then 'sam2' else 'hsv' end"
    if name in ("mask_path", "annotation"):
        base = f"case when c_custkey%3=0 then {base} end"
    if not stored:
        return f"{base} {name}"
    other = {"varchar(20)": "'other'", "boolean": f"not ({base})", "double": "cast(null as double)"}[kind]
    return f"case when c_custkey%41={place} then {other} else {base} end {name}"


def _settings(stored: bool) -> str:
    columns = ", ".join(_setting(n, k, stored) for k, n in enumerate(provenance.COMPARED) if n != "sample_id")
    return f"select concat('slide-', cast(c_custkey as varchar(20))) sample_id, {columns} from {{customer}}" + (" where c_custkey%13<>0" if stored else "")


def _compared() -> str:
    white, black, grey, blur = (f"n.filter_{x}" for x in ("white", "black", "grayspace", "blur"))
    when = {"mask_backend": "n.mask_path is not null", "tissue_method": "t.mask_path is null", "sam2_checkpoint_path": "t.tissue_method='sam2'", "sam2_config_path": "t.tissue_method='sam2'", "white_threshold": white, "black_threshold": black, "fraction_threshold": f"({white} or {black})", "grayspace_saturation_threshold": grey, "grayspace_fraction_threshold": grey, "blur_threshold": blur, "qc_spacing_um": f"({white} or {black} or {grey} or {blur})"}
    cases = " ".join(f"when {when.get(n, 'true')} and n.{n} is distinct from t.{n} then '{n}'" for n in provenance.COMPARED)
    return f"select n.sample_id, case when t.sample_id is null then 'new' {cases} else 'ok' end first_mismatch from now_ n left join then_ t on t.sample_id=n.sample_id"


def _typed(sql: str) -> str:
    return sql.format(customer="customer").replace("varchar(20)", "varchar")


@query(f"with now_ as ({_typed(_settings(False))}), then_ as ({_typed(_settings(True))}) {_compared()}")
def artifact_validation(f: Fixtures) -> DataFrame:
    """The first of 36 settings in which stored tiles differ from what is asked for."""
    now, then = (f.spark.sql(_settings(stored), customer=f.table("customer")) for stored in (False, True))
    return provenance.first_mismatch(now, then).select("sample_id", "first_mismatch")


@query("select sample_id, case when row_id%3=0 and row_id%4<>0 then 'none' when row_id%4=0 and (row_id%3<>0 or row_id%5=0) then 'reuse' else 'missing sidecar' end found from manifest", "manifest")
def artifact_reuse(f: Fixtures) -> DataFrame:
    arrays = f.manifest.where("row_id % 3 <> 0").select("sample_id")
    sidecars = f.manifest.where("row_id % 4 = 0").select("sample_id", F.when(F.col("row_id") % 5 == 0, F.lit(0)).otherwise(F.lit(7)).alias("n_tiles"))
    return provenance.reusable(f.manifest.select("sample_id"), arrays, sidecars).select("sample_id", "found")


#: Values by name of the metadata query; every other name is null.
META = {"sample_id": "m.sample_id", "image_path": "m.image_path", "mask_path": "case when m.row_id%2=0 then '/mask/1.tif' end", "backend": "'vips'", "requested_backend": "'auto'", "spacing_at_level_0": "m.override_um", "dimensions": "[1024, cast(1024+m.row_id%8 as integer)]", "base_spacing_um": "cast(0.25 as double)", "requested_tile_size_px": "256", "requested_spacing_um": "cast(0.5 as double)", "read_level": "1", "overlap": "cast(0.0 as double)", "is_within_tolerance": "true", "n_tiles": "m.row_id", "tissue_method": "'hsv'", "a_t": "4", "filter_white": "m.row_id%3=0", "coordinate_space": "'level_0'", "output_mode": "'per_annotation'"}


@query("select m.sample_id, to_json({" + ", ".join(f"'{section}': {{" + ", ".join(f"'{n}': {META.get(n, 'null')}" for n in names) + "}" for section, names in provenance.SECTIONS.items()) + "}) meta from manifest m", "manifest")
def tiling_metadata(f: Fixtures) -> DataFrame:
    """All six sections with all their names."""
    spark_sql = {n: v.replace("[1024, ", "array(1024, ").replace("as integer)]", "as int))") for n, v in META.items()}
    rows = f.manifest.alias("m").select(F.col("m.sample_id").alias("_key"), *(F.expr(v).alias(n) for n, v in spark_sql.items()))
    return rows.select(F.col("_key").alias("sample_id"), provenance.metadata(rows).cast("string").alias("meta"))


STORE = "select cast(o_orderkey%4+1 as int) num_workers, cast(o_orderkey%97 as bigint) tiles, (o_orderkey%11)/cast(4 as double) read_s, (o_orderkey%7)/cast(4 as double) encode_s, (o_orderkey%5)/cast(4 as double) write_s, (o_orderkey%11+o_orderkey%7+o_orderkey%5)/cast(4 as double) total_s, (o_orderkey%64)/cast(8 as double) tiles_per_second from {orders}"


@query("with s as (" + STORE.format(orders="orders") + ") select num_workers, cast(sum(tiles) as bigint) tiles, " + ", ".join(f"round(avg({c}_s), 6) mean_{c}_s" for c in ("read", "encode", "write", "total")) + ", " + ", ".join(f"round(avg(case when total_s > 0 then {c}_s/total_s*100 else 0.0 end), 2) mean_{c}_pct" for c in ("read", "encode", "write")) + ", round(avg(tiles_per_second), 2) mean_tiles_per_second, round(stddev_pop(tiles_per_second), 2) std_tiles_per_second from s group by 1")
def store_summary(f: Fixtures) -> DataFrame:
    return runs.store_summary(f.spark.sql(STORE, orders=f.table("orders")))


@query("select sample_id, case when row_id%2=0 then ['artifact'] else [] end missing, case when row_id%3=0 then ['extra'] else [] end unexpected from manifest", "manifest")
def schema_check(f: Fixtures) -> DataFrame:
    keys = F.concat(F.array(F.lit("provenance"), F.lit("slide")), F.when(F.col("row_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("artifact"))), F.when(F.col("row_id") % 3 == 0, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>")))
    return labels.key_differences(f.manifest.withColumn("keys", keys), ("provenance", "slide", "artifact")).select("sample_id", "missing", "unexpected")


@query(CANDIDATES + "select slide_id, tile_index, x, y, printf('%06d.jpg', tile_index) member from tiles", "slides", "mask_px")
def tar_manifest(f: Fixtures) -> DataFrame:
    return f.tiles.select("slide_id", "tile_index", "x", "y", F.format_string("%06d.jpg", "tile_index").alias("member"))


@query(CANDIDATES + "select slide_id, tile_index, x, y, frac from tiles", "slides", "mask_px")
def artifact_roundtrip(f: Fixtures) -> DataFrame:
    """Tiles packed to the stored artifact, a compressed array archive, and read back."""
    from gridquarry.sources import artifacts

    return artifacts.unpacked(artifacts.packed(f.tiles))


@query("select distinct annotation, case when annotation is null or annotation='tissue' then 's1' else annotation||'/s1' end stem from rows", "rows")
def annotation_path_rule(f: Fixtures) -> DataFrame:
    return f.rows.select("annotation", names.artifact_stem(F.lit("s1"), F.col("annotation")).alias("stem")).distinct()


NAMES = "nm as (select * from (values ('ok'), (''), (' pad'), ('..'), ('a/b'), ('a\\b'), ('tissue')) v(name))"


@query(f"with {NAMES} select name, not (trim(name)='' or trim(name)<>name or name in ('.','..') or contains(name,'/') or contains(name,'\\')) valid from nm", "steps")
def annotation_name_check(f: Fixtures) -> DataFrame:
    given = f.spark.createDataFrame([(n,) for n in ("ok", "", " pad", "..", "a/b", "a\\b", "tissue")], "name string")
    return given.select("name", names.valid_annotation(F.col("name")).alias("valid"))


@query("select distinct slide_id, label from label_px where label not in (select value from vocabulary where annotation<>'stroma')", "label_px", "vocabulary")
def label_subset_check(f: Fixtures) -> DataFrame:
    return labels.unknown_labels(f.label_px, f.vocabulary.where("annotation <> 'stroma'")).select("slide_id", "label")


@query("select annotation, 'left' only_in from (select annotation from vocabulary except select distinct annotation from rows) union all select annotation, 'right' from (select distinct annotation from rows where annotation is not null except select annotation from vocabulary)", "vocabulary", "rows")
def vocabulary_check(f: Fixtures) -> DataFrame:
    return labels.vocabulary_differences(f.vocabulary, f.rows.where("annotation is not null"))


LAYERS = "ly as (select annotation, 0 layer, value from vocabulary union all select 'stroma', 1, null union all select 'tumor', 1, 9 union all select 'vessel', 1, 4)"


@query(f"with {LAYERS} select annotation, arg_max(coalesce(value,-1), layer) value from ly group by 1 having arg_max(coalesce(value,-1), layer) >= 0", "vocabulary")
def drop_null_labels(f: Fixtures) -> DataFrame:
    more = f.spark.createDataFrame([("stroma", 1, None), ("tumor", 1, 9), ("vessel", 1, 4)], "annotation string, layer int, value int")
    return labels.merged_vocabulary(f.vocabulary.select("annotation", F.lit(0).alias("layer"), "value").unionByName(more))


PROBLEMS = "pr as (select annotation, value from vocabulary union all select 'copy', 2 union all select 'wide', 300)"


@query(f"with {PROBLEMS} select annotation, value, problem from (select *, case when value not between 0 and 255 then 'range' when count(*) over (partition by value) > 1 then 'shared' end problem from pr) where problem is not null", "vocabulary")
def pixel_mapping_check(f: Fixtures) -> DataFrame:
    more = f.spark.createDataFrame([("copy", 2), ("wide", 300)], "annotation string, value int")
    return labels.mapping_problems(f.vocabulary.select("annotation", "value").unionByName(more))


@query("select value, case when value=3 then 0 else value*10 end r, case when value=3 then 0 else 20 end g, case when value=3 then 0 else 30 end b from vocabulary", "vocabulary")
def palette(f: Fixtures) -> DataFrame:
    color = F.when(F.col("value") != 3, F.array(F.col("value") * 10, F.lit(20), F.lit(30)))
    return labels.palette(f.vocabulary.withColumn("color", color))


@query("select slide_id, mx, my, case when label=3 then 0.0 else 0.5 end alpha from label_px", "label_px")
def overlay_alpha(f: Fixtures) -> DataFrame:
    return labels.overlay_alpha(f.label_px, 3, 0.5).select("slide_id", "mx", "my", F.col("alpha").cast("decimal(2,1)").alias("alpha"))


@query(CANDIDATES + "select slide_id, tile_index, cast(ceil(x/cast(20 as double)) as bigint) px, cast(ceil(y/cast(20 as double)) as bigint) py, cast(7 as bigint) side from tiles", "slides", "mask_px")
def preview_rects(f: Fixtures) -> DataFrame:
    return preview.rectangles(f.tiles, 20, 128)


@query("select slide_id, level, cast(ceil(width/100.0)*100 as bigint) padded_w, cast(ceil(height/100.0)*100 as bigint) padded_h from pyramid", "pyramid")
def pad_to_patch(f: Fixtures) -> DataFrame:
    return preview.padded_size(f.pyramid, 100).select("slide_id", "level", "padded_w", "padded_h")


@query("select slide_id, level, cast(greatest(1.0, round_even(cast(10 as double)/downsample_x, 0)) as int) stroke from pyramid", "pyramid")
def stroke_thickness(f: Fixtures) -> DataFrame:
    return preview.stroke(f.pyramid, 10.0).select("slide_id", "level", "stroke")


@query("select backend, count(*) n, round(avg(cast(num_tiles as double)), 9) mean, round(stddev_pop(cast(num_tiles as double)), 9) spread from rows group by 1", "rows")
def bench_summary(f: Fixtures) -> DataFrame:
    out = runs.benchmark_summary(f.rows.withColumn("tiles_per_second", F.col("num_tiles").cast("double")), "backend")
    return out.select("backend", "n", F.round("mean", 9).alias("mean"), F.round("spread", 9).alias("spread"))


@query("select event_type, date_trunc('day', ts) as day_, count(*) n, round(sum(value), 6) total from events group by all")
def windowed_progress(f: Fixtures) -> DataFrame:
    from gridquarry.streaming.frontend import windowed

    return windowed(f.table("events"), "1 day").select("event_type", F.col("window.start").alias("day_"), "n", F.round("total", 6).alias("total"))

"""Slides, rasters and run tables derived from the driver's tables.

The driver's tables hold no images.  Each relation below is plain SQL that means
the same to Spark and to DuckDB, so queries and their oracles start from equal rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32

SQL = {
    "slides": """select concat('slide-', cast(s_suppkey as varchar(20))) sample_id, s_suppkey slide_id,
 cast(1024+64*(s_suppkey%8) as bigint) slide_w, cast(1024+64*(s_suppkey%5) as bigint) slide_h,
 case when s_suppkey%2=0 then cast(0.25 as double) else cast(0.5 as double) end base_spacing_um from {supplier}""",
    "steps": "select 0 level, 1 d union all select 1, 2 union all select 2, 4 union all select 3, 8",
    "pyramid": """select s.slide_id, t.level, cast(floor(s.slide_w / t.d) as bigint) width, cast(floor(s.slide_h / t.d) as bigint) height,
 cast(t.d as double) downsample_x, cast(t.d as double) downsample_y, s.base_spacing_um * t.d spacing_um from {slides} s cross join {steps} t""",
    "wishes": """select cast(0.2 as double) requested, cast(0.05 as double) tolerance union all select cast(0.5 as double), cast(0.05 as double) union all select cast(0.9 as double), cast(0.07 as double)
 union all select cast(2.1 as double), cast(0.1 as double) union all select cast(3.5 as double), cast(0.01 as double) union all select cast(5.0 as double), cast(0.05 as double)""",
    "mask_px": "select distinct l_suppkey slide_id, cast((l_partkey*7)%32 as bigint) mx, cast(l_orderkey%32 as bigint) my from {lineitem}",
    "label_px": """select l_suppkey slide_id, cast((l_partkey*7)%32 as bigint) mx, cast(l_orderkey%32 as bigint) my, min(cast(1+l_linenumber%3 as int)) label
 from {lineitem} group by l_suppkey, (l_partkey*7)%32, l_orderkey%32""",
    "vocabulary": """select 'tumor' annotation, 1 value, cast(0.1 as double) min_coverage, 1 place union all select 'stroma', 2, cast(0.2 as double), 2
 union all select 'necrosis', 3, cast(null as double), 3""",
    "rgb_px": """select d.slide_id, d.x, d.y, coalesce(p.r, 200) r, coalesce(p.g, 60) g, coalesce(p.b, 180) b
 from (select s_suppkey slide_id, a.x, u.y from {supplier} cross join (select distinct cast(p_partkey%32 as bigint) x from {part}) a cross join (select distinct cast(p_partkey%32 as bigint) y from {part}) u) d
 left join (select l_suppkey slide_id, cast((l_partkey*7)%32 as bigint) x, cast(l_orderkey%32 as bigint) y, cast(sum(l_partkey*37+l_orderkey*11)%256 as int) r, cast(sum(l_partkey*91+l_orderkey*5)%256 as int) g, cast(sum(l_partkey*53+l_orderkey*17)%256 as int) b
 from {lineitem} group by l_suppkey, (l_partkey*7)%32, l_orderkey%32) p on p.slide_id=d.slide_id and p.x=d.x and p.y=d.y""",
    "rows": """select o_orderkey row_id, concat('slide-', cast(o_custkey as varchar(20))) sample_id, case when o_orderkey%3=0 then 'tissue' when o_orderkey%3=1 then 'tumor' else null end annotation,
 case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'queued' end tiling_status, cast(o_orderkey%50 as int) num_tiles,
 case when o_orderkey%4=0 then '  ' when o_orderkey%4=1 then 'cannot open' when o_orderkey%4=2 then 'empty mask' else null end error,
 concat('/data/', cast(o_custkey%7 as varchar(20)), case when o_custkey%3=0 then '.PNG' when o_custkey%3=1 then '.svs' else '.tiff' end) image_path,
 case when o_orderkey%5=0 then null else concat('/mask/', cast(o_orderkey%3 as varchar(20)), '.tif') end mask_path,
 case when o_orderkey%2=0 then 'vips' else 'openslide' end backend, case when o_orderkey%7=0 then null else 'vips' end mask_backend from {orders}""",
    "manifest": """select c_custkey row_id, concat('slide-', cast(c_custkey as varchar(20))) sample_id, concat('/data/', cast(c_custkey%7 as varchar(20)), case when c_custkey%3=0 then '.PNG' when c_custkey%3=1 then '.svs' else '.tiff' end) image_path,
 case when c_custkey%4=0 then null when c_custkey%4=1 then 'NaN' when c_custkey%4=2 then ' ' else '/mask/1.tif' end raw_mask_path, cast(null as varchar(20)) spare,
 case when c_custkey%5=0 then null else cast(0.25 as double) end native_um, case when c_custkey%3=0 then cast(0.5 as double) else null end override_um from {customer}""",
    "openable": "select '/data/1.svs' image_path, 'asap' candidate union all select '/data/1.svs', 'vips' union all select '/data/2.tiff', 'openslide' union all select '/data/3.svs', 'cucim' union all select '/data/4.svs', 'asap'",
}
#: The name that dense rasters had when rgb_px was a part of them.
SQL["raster_px"] = SQL["rgb_px"]
#: What each relation is made from.
NEEDS = {"pyramid": ("slides", "steps")}
TABLES = ("supplier", "lineitem", "part", "orders", "customer")


def oracle(body: str, *names: str) -> str:
    """A query for DuckDB: the relations that it names, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    named = {t: t for t in TABLES} | {n: n for n in SQL}
    parts = [f"{n} as ({SQL[n].format(**named).replace('varchar(20)', 'varchar')})" for n in order]
    body = body.strip()
    recursive = "recursive " if body.startswith("with recursive") else ""
    if body.startswith("with "):
        body = ", " + body[len("with " + recursive) :] if parts else body
    return (f"with {recursive}" + ", ".join(parts) + (" " if body.startswith(",") else "\n") + body) if parts else body


class Fixtures:
    """The relations as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SQL:
            raise AttributeError(name)
        if name not in self._made:
            inputs = {n: (getattr(self, n) if n in SQL else self.table(n)) for n in (*NEEDS.get(name, ()), *TABLES) if "{" + n + "}" in SQL[name]}
            self._made[name] = self.spark.sql(SQL[name], **inputs)
        return self._made[name]

    @cached_property
    def wished(self) -> DataFrame:
        """Each slide with its levels and each wish."""
        from gridquarry.operators.levels import with_levels

        return with_levels(self.slides, self.pyramid).crossJoin(F.broadcast(self.wishes))

    @cached_property
    def tiles(self) -> DataFrame:
        """Slide grids of 128-pixel tiles with step 96, covered to at least 0.4, indexed; written once, as what reads them does so several times."""
        from gridquarry.operators import coverage as cv
        from gridquarry.operators import grid
        from gridquarry.shared import stored

        found = cv.covered(cv.windows(grid.candidates(grid.slide_boxes(self.slides), 128, 96, ("slide_id", "slide_w", "slide_h")), SIDE, SIDE), self.mask_px, ["slide_id"])
        return grid.indexed(stored(cv.at_least(found, 0.4).select("slide_id", "x", "y", "frac"), "tiles"), ["slide_id"])


#: The same tiles for DuckDB; goes in front of other common tables.
CANDIDATES = """with cand as (select s.slide_id, s.slide_w, s.slide_h, x, y,
 cast(floor(x * (cast(32 as double)/s.slide_w)) as bigint) wx, cast(floor(y * (cast(32 as double)/s.slide_h)) as bigint) wy,
 cast(greatest(1.0, round_even(128 * (cast(32 as double)/s.slide_w), 0)) as bigint) ww, cast(greatest(1.0, round_even(128 * (cast(32 as double)/s.slide_h), 0)) as bigint) wh
 from (select *, unnest(range(0, slide_w, 96)) x from slides) s, unnest(range(0, s.slide_h, 96)) u(y)),
 scored as (select c.slide_id, c.x, c.y, count(*) n_px, cast(cast(count(*) as double) / any_value(c.ww*c.wh) as float) frac
 from cand c join mask_px m on m.slide_id=c.slide_id and m.mx>=c.wx and m.mx<c.wx+c.ww and m.my>=c.wy and m.my<c.wy+c.wh group by all),
 tiles as (select slide_id, x, y, frac, cast(row_number() over (partition by slide_id order by x, y) - 1 as int) tile_index from scored where frac >= cast(0.4 as float))
"""

"""Bookkeeping of runs: backends, status rows, resuming, failures, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.functions import names

#: Reader back ends by priority.
BACKENDS = ("cucim", "vips", "openslide", "asap")
SUCCESS, FAILED = "success", "failed"
#: Columns whose values have to agree, nulls included, for an earlier result to be used again.
COMPARED = ("image_path", "mask_path", "backend", "mask_backend")


def duplicate_ids(slides: DataFrame, key: str = "sample_id") -> DataFrame:
    return slides.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve_backend(paths: DataFrame, openable: DataFrame, path_col: str = "image_path", out: str = "backend") -> DataFrame:
    """Flat rasters are read by one backend only; others by the first in priority that can open the file.  openable: (path_col, candidate)."""
    rank = F.array_position(F.array(*[F.lit(b) for b in BACKENDS]), F.col("candidate"))
    first = openable.groupBy(path_col).agg(F.min(F.struct(rank.alias("rank"), "candidate")).alias("_b"))
    flat = names.suffix(F.col(path_col)).isin(*names.FLAT_SUFFIXES)
    return paths.join(first, path_col, "left").withColumn(out, F.when(flat, F.lit("pil")).otherwise(F.col("_b.candidate"))).drop("_b")


def worker_allocation(total: int, pending) -> tuple:
    """(outer, inner): processes over slides, and threads inside each."""
    outer = F.greatest(F.lit(1), F.least(F.lit(total), pending))
    return outer.cast("int"), F.greatest(F.lit(1), F.floor(F.lit(total) / outer)).cast("int")


def process_rows(slides: DataFrame, outcome: DataFrame) -> DataFrame:
    """One status row for each slide and annotation.  outcome: sample_id, annotation, num_tiles, error (null when it went well)."""
    good = F.col("error").isNull()
    stem = names.artifact_stem(F.col("sample_id"), F.col("annotation"))
    path = lambda end, when: F.when(when, F.concat(stem, F.lit(end)))
    return slides.join(outcome, "sample_id").select(
        "sample_id",
        "annotation",
        "image_path",
        F.when(good, F.lit(SUCCESS)).otherwise(F.lit(FAILED)).alias("tiling_status"),
        F.when(good, F.col("num_tiles")).otherwise(F.lit(0)).cast("int").alias("num_tiles"),
        path(".coordinates.npz", good & (F.col("num_tiles") > 0)).alias("coordinates_npz_path"),
        path(".coordinates.meta.json", good).alias("coordinates_meta_path"),
        "error",
    )


def latest_successes(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Of each sample's successes the last; maxima combine before the shuffle."""
    rest = [c for c in rows.columns if c not in ("sample_id", order)]
    last = rows.where(F.col("tiling_status") == SUCCESS).groupBy("sample_id").agg(F.max(F.struct(order, *rest)).alias("_l"))
    return last.select("sample_id", *(F.col(f"_l.{c}").alias(c) for c in [order, *rest]))


def validated(current: DataFrame, earlier: DataFrame, columns: tuple[str, ...] = COMPARED) -> DataFrame:
    """current with first_mismatch: the first column in which the earlier result differs, null-safe; new where there is none, ok where all agree."""
    old = earlier.select("sample_id", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in columns))
    first = F.when(F.col("_there").isNull(), F.lit("new"))
    for c in columns:
        first = first.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c))
    return current.join(old, "sample_id", "left").withColumn("first_mismatch", first.otherwise(F.lit("ok"))).drop("_there", *(f"_{c}" for c in columns))


def merged_metadata(current: DataFrame, earlier: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Values of the current row, or else of the earlier one."""
    old = earlier.select("sample_id", *(F.col(c).alias(f"_{c}") for c in columns))
    out = current.join(old, "sample_id", "left")
    return out.select("sample_id", *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns))


def without_failures(work: DataFrame, failures: DataFrame) -> DataFrame:
    return work.join(failures.select("sample_id"), "sample_id", "left_anti")


def failed_slides(rows: DataFrame) -> DataFrame:
    """By sample: distinct reasons in order of first appearance, joined by a bar; blank is an unknown error."""
    reason = F.when(F.trim(F.coalesce("error", F.lit(""))) == "", F.lit("unknown error")).otherwise(F.trim("error"))
    first = rows.where(F.col("tiling_status") == FAILED).withColumn("reason", reason).groupBy("sample_id", "reason").agg(F.min("row_id").alias("at"))
    return first.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("at", "reason"))).alias("r")).select("sample_id", F.concat_ws(" | ", F.transform("r", lambda x: x["reason"])).alias("reasons"))


def progress(rows: DataFrame) -> DataFrame:
    status = F.col("tiling_status")
    return rows.agg(
        F.count_if(status == SUCCESS).alias("completed"),
        F.count_if(status == FAILED).alias("failed"),
        F.count_if(~status.isin(SUCCESS, FAILED)).alias("pending"),
        F.count_if((status == SUCCESS) & (F.col("num_tiles") == 0)).alias("zero_tile"),
        F.coalesce(F.sum(F.when(status == SUCCESS, F.col("num_tiles"))), F.lit(0)).cast("bigint").alias("discovered_tiles"),
    )


def input_order(results: DataFrame, manifest: DataFrame, order: tuple[str, ...] = ("annotation",), bucket: int = 1000) -> DataFrame:
    """Results with the place of their slide in the manifest, first appearance first, and out_index, their own place: 0..n-1, rows of a slide by `order`.

    Rows are numbered inside buckets of manifest rows; a window over the few bucket sizes gives each bucket's offset.
    """
    place = manifest.groupBy("sample_id").agg(F.min("row_id").alias("input_index"))
    placed = results.join(place, "sample_id").withColumn("_b", F.floor(F.col("input_index") / bucket))
    sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("input_index", *(F.col(c).asc_nulls_first() for c in order))) - 1
    return placed.withColumn("_i", inside).join(offsets, "_b").withColumn("out_index", (F.col("_before") + F.col("_i")).cast("bigint")).drop("_b", "_i", "_before")


def tile_rollup(rows: DataFrame) -> DataFrame:
    """Tile counts by sample and annotation, by sample, and altogether."""
    return rows.rollup("sample_id", "annotation").agg(F.sum("num_tiles").cast("bigint").alias("num_tiles"))


def cache_skip(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs whose fingerprint is not that of an earlier, finished job."""
    signed = jobs.withColumn("signature", F.sha2(F.concat_ws("|", "sample_id", "image_path", F.col("size").cast("string")), 256))
    return signed.join(cache.select("signature"), "signature", "left_anti")


def benchmark_summary(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("tiles_per_second").alias("mean"), F.stddev_pop("tiles_per_second").alias("spread"))


def store_summary(rows: DataFrame) -> DataFrame:
    """Timings of tile stores by number of workers: rows have num_workers, tiles, read_s, encode_s, write_s, total_s, tiles_per_second."""
    share = lambda c: F.round(F.avg(F.when(F.col("total_s") > 0, F.col(f"{c}_s") / F.col("total_s") * 100).otherwise(F.lit(0.0))), 2).alias(f"mean_{c}_pct")
    phases = ("read", "encode", "write")
    return rows.groupBy("num_workers").agg(
        F.sum("tiles").cast("bigint").alias("tiles"),
        *(F.round(F.avg(f"{c}_s"), 6).alias(f"mean_{c}_s") for c in (*phases, "total")),
        *(share(c) for c in phases),
        F.round(F.avg("tiles_per_second"), 2).alias("mean_tiles_per_second"),
        F.round(F.stddev_pop("tiles_per_second"), 2).alias("std_tiles_per_second"),
    )


def openable(paths: DataFrame, candidates: tuple[str, ...] = ("pil",), path_col: str = "image_path", spacing_col: str | None = None) -> DataFrame:
    """(path_col, candidate, ok, reason): which back ends open each file, tried once for every distinct path on the executors."""
    import pandas as pd

    kinds = dict(paths.dtypes)
    own = paths.select(F.col(path_col), (F.col(spacing_col) if spacing_col else F.lit(1.0)).cast("double").alias("_um")).distinct()

    def trial(frames):
        from gridquarry.sources.rasters import open_raster

        for frame in frames:
            out = []
            for path, um in zip(frame[path_col], frame["_um"], strict=True):
                for name in candidates:
                    try:
                        open_raster(path, name, um)
                        out.append((path, name, True, None))
                    except (RuntimeError, ValueError) as error:
                        out.append((path, name, False, str(error)))
            yield pd.DataFrame(out, columns=[path_col, "candidate", "ok", "reason"])

    return own.mapInPandas(trial, f"`{path_col}` {kinds[path_col]}, candidate string, ok boolean, reason string")

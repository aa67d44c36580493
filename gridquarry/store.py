"""Results of runs in a folder: what is there, what may be used again, and replacing the rest at once.

    coordinates/annotation=A/part=P/   tiles, slides dealt to parts by a hash
    metadata/annotation=A/part=P/      the settings that each result was made with
    process_list/, summary/            the status rows of the last run, long and short (CSV)
    tiles/                             an array file and a JSON file for each result
    journal/change.json                a change that is decided and not yet carried out

A change is prepared in staging/: the parts it touches are written anew, with the
results that stay.  Then the journal is written, by one rename: from there on the
change holds.  Carrying it out moves staged folders and files to their places
and can be repeated; `recover` does so after a crash, or sweeps away what was staged
without a journal.  Readers of a finished store need nothing but the folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.operators import provenance
from gridquarry.shared import stored
from gridquarry.sources import artifacts, file_sets, sinks

TABLES = ("coordinates", "metadata")
#: Slides that a part is meant to hold when a store is made.
PART_SLIDES = 200
PAIR = ("sample_id", "annotation")


class Files:
    """The few calls on folders that a change needs, on whatever file system Spark has."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def qualified(self, path: str) -> str:
        """A plain path on a default file system that is not local, as a URI, so that tasks mean the same folder."""
        fs, at = self._at(path)
        return path if "://" in path or fs.getScheme() == "file" else fs.makeQualified(at).toString()

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def move(self, source: str, target: str) -> None:
        """target is replaced.  Repeating a move that was made changes nothing."""
        fs, at = self._at(source)
        if not fs.exists(at):
            return
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        fs.delete(to, True)
        if not fs.rename(at, to):
            raise OSError(f"cannot move {source} to {target}")

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all."""
        fs, at = self._at(f"{path}.new")
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(f"{path}.new", path)


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark)
        self.folder = self.files.qualified(folder.rstrip("/"))

    def at(self, *names: str) -> str:
        return "/".join((self.folder, *names))

    def recover(self) -> bool:
        """Carry out a decided change that a crash cut short, sweep away an undecided one; whether there was a decided one."""
        decided = self.files.exists(self.at("journal", "change.json"))
        if decided:
            self._carry_out(json.loads(self.files.read(self.at("journal", "change.json"))))
        self.files.delete(self.at("staging"))
        return decided

    def _table(self, name: str) -> DataFrame | None:
        path = self.at(name)
        if not self.files.exists(f"{path}/_layout"):
            return None
        schema = json.loads(self.files.read(f"{path}/_layout"))["schema"]
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def tiles(self) -> DataFrame | None:
        """slide_id (the sample), tile_index, x, y, frac, annotation and part."""
        return self._table("coordinates")

    def settings(self) -> DataFrame | None:
        """One row for each result: what it was made with, and n_tiles."""
        return self._table("metadata")

    def parts(self, slides: int) -> int:
        """Parts of this store; a new one gets them by the number of its slides."""
        path = self.at("coordinates", "_layout")
        return json.loads(self.files.read(path))["parts"] if self.files.exists(path) else max(1, -(-slides // PART_SLIDES))

    def standing(self, wanted: DataFrame) -> DataFrame:
        """wanted (settings by sample_id and annotation) with first_mismatch and n_tiles of what is stored: ok may be used again."""
        there = self.settings()
        if there is None:
            return wanted.withColumn("first_mismatch", F.lit("new")).withColumn("n_tiles", F.lit(None).cast("bigint"))
        told = provenance.first_mismatch(wanted, there, PAIR, tuple(c for c in wanted.columns if c not in provenance.COMPARED and c in there.columns))
        return told.join(there.select(*PAIR, "n_tiles"), list(PAIR), "left")

    def replace(self, changed: DataFrame, tiles: DataFrame, settings: DataFrame, tables: dict[str, DataFrame], texts: dict[str, str], whole: bool = False) -> None:
        """Results of the pairs in `changed` go; those in tiles and settings come; tables (CSV) and texts are replaced as a whole.

        tiles: sample_id, annotation, tile_index, x, y, frac.  settings: sample_id, annotation, meta
        (text), n_tiles and what is compared.  whole: nothing that is there stays.
        """
        n = self.parts(changed.select("sample_id").distinct().count())
        part = F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int")
        changed = stored(changed.select(*PAIR).distinct().withColumn("part", part), "changed")
        touched = changed.select("annotation", "part").distinct()
        new = {"coordinates": tiles.withColumn("part", part).withColumnRenamed("sample_id", "slide_id"), "metadata": settings.withColumn("part", part)}
        order = {"coordinates": ["slide_id", "tile_index"], "metadata": ["sample_id"]}
        plan: dict = {"parts": n, "whole": whole, "schema": {}, "folders": []}
        plan["gone"], plan["files"] = [], []
        if whole or not changed.isEmpty():
            for name in TABLES:
                own, old = new[name], None if whole else self._table(name)
                if old is not None:
                    key = order[name][0]
                    kept = old.join(F.broadcast(touched) if touched.count() < 100_000 else touched, ["annotation", "part"], "left_semi").join(changed.select(F.col("sample_id").alias(key), "annotation"), [key, "annotation"], "left_anti")
                    own = own.unionByName(kept.select(own.columns))
                staged = self.at("staging", name)
                sinks.checked_names(own).repartition("annotation", "part", order[name][0]).sortWithinPartitions("annotation", "part", *order[name]).write.mode("overwrite").partitionBy("annotation", "part").parquet(staged)
                plan["schema"][name] = self._ddl(own)
            plan["folders"] = [f"annotation={sinks.folder_name(r['annotation'])}/part={r['part']}" for r in touched.toLocalIterator()]
            file_sets.write(self._pairs(tiles, settings), self.at("staging", "tiles"))
            gone = changed.join(settings.where("n_tiles > 0").select(*PAIR), list(PAIR), "left_anti")
            plan["files"] = [[r["stem"], r["n_tiles"]] for r in settings.select(sinks.stem().alias("stem"), "n_tiles").toLocalIterator()]
            plan["gone"] = [r["stem"] for r in gone.select(sinks.stem().alias("stem")).toLocalIterator()]
        for name, rows in tables.items():
            sinks.run_table(rows, self.at("staging", "tables", name))
        plan["tables"], plan["texts"] = list(tables), texts
        self.files.write(self.at("journal", "change.json"), json.dumps(plan))
        self.recover()

    @staticmethod
    def _ddl(frame: DataFrame) -> str:
        kinds = dict(frame.dtypes)
        return ", ".join(f"`{c}` {kinds[c]}" for c in [*(c for c in frame.columns if c not in ("annotation", "part")), "annotation", "part"])

    @staticmethod
    def _pairs(tiles: DataFrame, settings: DataFrame) -> DataFrame:
        """For each result its metadata, and its arrays where it has tiles, as one set of files."""
        packed = artifacts.packed(tiles.withColumn("slide_id", F.concat_ws("\n", "annotation", "sample_id")), "string").select(F.col("slide_id").alias("_k"), "npz")
        both = settings.withColumn("_k", F.concat_ws("\n", "annotation", "sample_id")).join(packed, "_k", "left")
        meta = F.struct(F.lit(".coordinates.meta.json").alias("suffix"), F.encode("meta", "utf-8").alias("data"))
        arrays = F.struct(F.lit(".coordinates.npz").alias("suffix"), F.col("npz").alias("data"))
        return both.select(sinks.stem().alias("stem"), F.when(F.col("npz").isNull(), F.array(meta)).otherwise(F.array(arrays, meta)).alias("files"))

    def _carry_out(self, plan: dict) -> None:
        """Every step may be repeated: what is staged moves, what is not there any more has moved."""
        for name in (*TABLES, "tiles") if plan["whole"] else ():
            if not self.files.exists(self.at("staging", f"{name}-cleared")):
                self.files.delete(self.at(name))
                self.files.write(self.at("staging", f"{name}-cleared"), "")
        for name in TABLES:
            for folder in plan["folders"]:
                staged, final = self.at("staging", name, folder), self.at(name, folder)
                if self.files.exists(staged):
                    self.files.move(staged, final)
                    self.files.write(self.at("staging", f"{name}-done", folder), "")
                elif not self.files.exists(self.at("staging", f"{name}-done", folder)):
                    self.files.delete(final)
            if name in plan["schema"]:
                self.files.write(self.at(name, "_layout"), json.dumps({"parts": plan["parts"], "schema": plan["schema"][name]}))
        for stem in plan["gone"]:
            self.files.delete(self.at("tiles", f"{stem}.coordinates.npz"))
        kept = {stem for stem, _ in plan["files"]}
        for stem in plan["gone"]:
            if stem not in kept:
                self.files.delete(self.at("tiles", f"{stem}.coordinates.meta.json"))
        for stem, n in plan["files"]:
            for suffix in ((".coordinates.npz",) if n else ()) + (".coordinates.meta.json",):
                self.files.move(self.at("staging", "tiles", stem + suffix), self.at("tiles", stem + suffix))
        for name in plan["tables"]:
            self.files.move(self.at("staging", "tables", name), self.at(name))
        for name, text in plan["texts"].items():
            self.files.write(self.at(name), text)
        self.files.delete(self.at("journal"))

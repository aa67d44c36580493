"""Files written from rows, in sets that are there whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def located(where: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, of a plain path or a URI."""
    return pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)


@dataclass
class Written(WriterCommitMessage):
    """What a task has put aside: for each set, the pairs (where it lies, where it belongs)."""

    sets: list[list[tuple[str, str]]]


class SetWriter(DataSourceWriter):
    """Tasks write to a folder of the job; the commit moves one set after the other into place.

    A set whose move fails is taken back before the error goes on, so no half of it stays; a task
    or job that fails leaves the target as it was, as all it wrote lies in the job's folder.
    """

    def __init__(self, path: str):
        self.path, self.job = path, f"{path}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, job = located(self.job)
        _, top = located(self.path)
        task, sets = uuid.uuid4().hex, []
        for row in iterator:
            moves = []
            for part in row["files"]:
                name = f"{row['stem']}{part['suffix']}"
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name below the folder: {name}")
                aside = f"{job}/{task}/{name}"
                fs.create_dir(aside.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(aside) as out:
                    out.write(bytes(part["data"]))
                moves.append((aside, f"{top}/{name}"))
            sets.append(moves)
        return Written(sets)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = located(self.path)
        try:
            for message in messages:
                for moves in message.sets if message else []:
                    self._promote(fs, moves)
        finally:
            self.abort(messages)

    def _promote(self, fs: pafs.FileSystem, moves: list[tuple[str, str]]) -> None:
        done: list[tuple[str, str | None]] = []
        try:
            for aside, final in moves:
                fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
                before = None
                if fs.get_file_info(final).type != pafs.FileType.NotFound:
                    before = f"{aside}.before"
                    fs.move(final, before)
                done.append((final, before))
                fs.move(aside, final)
        except Exception:
            for final, before in reversed(done):
                if fs.get_file_info(final).type != pafs.FileType.NotFound:
                    fs.delete_file(final)
                if before:
                    fs.move(before, final)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        fs, job = located(self.job)
        if fs.get_file_info(job).type != pafs.FileType.NotFound:
            fs.delete_dir(job)


class FileSets(DataSource):
    """df.write.format("file_sets").option("path", ...): rows of stem and files, an array of (suffix, data)."""

    @classmethod
    def name(cls) -> str:
        return "file_sets"

    def schema(self) -> str:
        return "stem string, files array<struct<suffix:string,data:binary>>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SetWriter(self.options["path"])


def write(sets: DataFrame, path: str) -> None:
    """sets: stem, files.  On a cluster, `path` has to be in a store that driver and executors reach."""
    sets.sparkSession.dataSource.register(FileSets)
    sets.select("stem", "files").write.format("file_sets").option("path", path).mode("append").save()

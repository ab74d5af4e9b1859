"""Files by URI or plain path, and a data source that writes rows as files: all of them or none."""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a plain path."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[fs.FileInfo]:
    """The files at path by name: itself, those of a folder, or those that a pattern (* and ?) in its last part fits;
    hidden ones are left out."""
    system, place = open_path(path.rstrip("/"))
    folder, _, last = place.rpartition("/")
    if pattern := last if "*" in last or "?" in last else None:
        place = folder
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = [f for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]
    return sorted((f for f in found if not f.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(f.base_name, pattern or "*")), key=lambda f: f.path)


def registered(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a source known to the session, once."""
    known = spark.__dict__.setdefault("_voxelweave_sources", set())
    if source.name() not in known:
        spark.dataSource.register(source)
        known.add(source.name())


@dataclass
class Part(WriterCommitMessage):
    """The folder with the files of a task's attempt; None if it had no rows."""

    folder: str | None


class FilesWriter(DataSourceWriter):
    """Each attempt writes to a folder of its own; the driver moves the files of those that count to their places.

    Should moving be cut off, a repeated write replaces the files. A write that fails leaves no file behind: the driver
    makes the job's folder, so that a task which is still being ended after the driver has deleted it can't bring it back.
    """

    def __init__(self, path: str, ext: str):
        self.path, self.ext, self.job = path.rstrip("/"), ext, f"_writing-{uuid.uuid4().hex}"
        system, place = open_path(self.path)
        system.create_dir(f"{place}/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> Part:
        system, place = open_path(self.path)
        task = TaskContext.get()
        folder, any_row = f"{place}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", False
        for row in iterator:
            if not any_row:
                system.create_dir(folder, recursive=False)
                any_row = True
            with system.open_output_stream(f"{folder}/{row.vol.rpartition('/')[2]}{self.ext}", compression=None) as f:
                f.write(bytes(row.content))
        return Part(folder if any_row else None)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = open_path(self.path)
        system.create_dir(place, recursive=True)
        for m in messages:
            if m is None or m.folder is None:
                continue
            for f in system.get_file_info(fs.FileSelector(m.folder)):
                there = f"{place}/{f.base_name}"
                if system.get_file_info(there).type == fs.FileType.File:
                    system.delete_file(there)
                system.move(f.path, there)
        self._clear(system, place)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*open_path(self.path))

    def _clear(self, system: fs.FileSystem, place: str) -> None:
        for left in range(9, -1, -1):
            if system.get_file_info(f"{place}/{self.job}").type != fs.FileType.Directory:
                return
            try:
                return system.delete_dir(f"{place}/{self.job}")
            except OSError:  # a task that is being ended has added a file meanwhile
                if not left:
                    raise
                time.sleep(0.2)


class Files(DataSource):
    """Rows (vol, content) as files of these names and bytes in a folder; option ext: what names end with."""

    @classmethod
    def name(cls) -> str:
        return "voxelweave_files"

    def schema(self) -> str:
        return "vol string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"], self.options.get("ext", ""))


def save(files: DataFrame, folder: str, ext: str) -> DataFrame:
    """Writes (vol, content) rows as files vol + ext in a folder, replacing files of these names; (vol, bytes) of all
    files of that ending there, but for empty ones, which are written and not listed. Names should be unique: of several
    rows with one name any one stays."""
    spark = files.sparkSession
    registered(spark, Files)
    files.select("vol", "content").write.format(Files.name()).option("ext", ext).mode("append").save(folder)
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.filter(name.endswith(ext)).select(F.substring(name, F.lit(1), F.length(name) - len(ext)).alias("vol"), F.col("length").alias("bytes"))

"""A folder tree as a table: listed and read in tasks.

``app_files`` is a data source whose partitions are groups of the folders below the root: the driver
looks at the names of one level, tasks walk the rest.  Only names and sizes come out of it, so they can be filtered, joined
and spread evenly before :func:`read_files` reads what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LISTING = "app_key string, file_path string, size long, modified timestamp"
#: Tasks that walk folders, at most; and the names a task gives off at a time.
WALKS = 4096
NAMES = 10_000
#: Bytes of files that a reading task gets, about, and gives off at a time.
READ_BYTES = 128 << 20
BATCH_BYTES = 16 << 20


def file_system(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if set(path) & set("*?[{"):
        raise ValueError("a corpus is one folder, not a pattern")
    if "://" not in path and not path.startswith("/"):
        path = path.replace(":", "://", 1)
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def _entries(system, folder: str):
    from pyarrow import fs

    return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name)


class Folders(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class AppFilesReader(DataSourceReader):
    def __init__(self, path: str, app_depth: int, hidden: bool) -> None:
        self.path, self.app_depth, self.hidden = path, app_depth, hidden

    def partitions(self) -> list[InputPartition]:
        names = [e.base_name for e in _entries(*file_system(self.path))]
        groups = min(WALKS, len(names))
        return [Folders(names[i::groups]) for i in range(groups)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = file_system(self.path)
        rows: list[tuple] = []
        todo = list(reversed(partition.names))
        while todo:
            name = todo.pop()
            if not self.hidden and name.rsplit("/", 1)[-1].startswith("."):
                continue
            entry = system.get_file_info(f"{root}/{name}")
            if entry.type == fs.FileType.Directory:
                # Only folders wait on the stack; their files are given off as they are seen.
                for below in reversed(_entries(system, f"{root}/{name}")):
                    if below.type == fs.FileType.Directory:
                        todo.append(f"{name}/{below.base_name}")
                    elif self.hidden or not below.base_name.startswith("."):
                        rows.append(self._row(f"{name}/{below.base_name}", below))
                        if len(rows) >= NAMES:
                            yield self._batch(rows)
                            rows = []
            elif entry.type == fs.FileType.File:
                rows.append(self._row(name, entry))
        yield self._batch(rows)

    def _row(self, name: str, entry) -> tuple:
        return ("/".join(name.split("/")[: self.app_depth]), name, entry.size or 0, entry.mtime_ns and entry.mtime_ns // 1000)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["app_key", "file_path", "size", "modified"])


class AppFiles(DataSource):
    """``spark.read.format("app_files").load(folder)``; options ``app_depth`` (1) and ``hidden`` (false)."""

    @classmethod
    def name(cls) -> str:
        return "app_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> AppFilesReader:
        hidden = str(self.options.get("hidden", "false")).lower() == "true"
        return AppFilesReader(self.options["path"], int(self.options.get("app_depth", 1)), hidden)


def list_files(spark: SparkSession, path: str, app_depth: int = 1, hidden: bool = False) -> DataFrame:
    """``(app_key, file_path, size, modified)`` of all files below ``path``, ``_`` names too.

    Paths are relative to ``path``; the first ``app_depth`` names on them are the app.  Names that start with ``.``, and what lies
    below them, only with ``hidden``.
    """
    file_system(path)  # a pattern is refused here, not in a task
    spark.dataSource.register(AppFiles)
    return spark.read.format("app_files").option("app_depth", app_depth).option("hidden", hidden).load(path)


def read_files(listing: DataFrame, path: str) -> DataFrame:
    """``(app_key, file_path, text)`` of the files of ``listing(app_key, file_path, size)`` below ``path``.

    Names are dealt out evenly before the files are read, so a folder that holds a third of all files is read by many tasks.
    Each file is one cell: one of 2 GB or more fails, as does a file that is gone.
    """
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total["n"], max(cores, -(-total["bytes"] // READ_BYTES))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        rows, held = [], 0
        for batch in batches:
            for app_key, name in zip(batch.column("app_key").to_pylist(), batch.column("file_path").to_pylist()):
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    content = stream.read()
                rows.append((app_key, name, content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
        if rows:
            yield _contents(rows)

    dealt = listing.select("app_key", "file_path").repartition(tasks, F.xxhash64("file_path"))
    raw = dealt.mapInArrow(read, "app_key string, file_path string, content binary")
    return raw.select("app_key", "file_path", F.col("content").cast("string").alias("text"))


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["app_key", "file_path", "content"])

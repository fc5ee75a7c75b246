"""Spark data sources over native files, by pyarrow's file systems: `vcr` snapshots, and `vcrlog` change logs as tables or streams.

    spark.dataSource.register(SnapshotSource)
    spark.read.format("vcr").load("/data/*.vcr")
    spark.readStream.format("vcrlog").options(dimensions=64).load("/data/a.vcr.log")

A file is a partition. Encrypted files are read by sources.binary, which decrypts in the JVM.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

from pyarrow import fs as afs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..types import CollectionConfig, FormatError
from . import binary

SNAPSHOT_SCHEMA = "path string, seq bigint, id_type tinyint, id string, embedding array<double>, context string"


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


def _matching(path: str) -> list[str]:
    """The files that a path, a folder or a pattern in its last part names."""
    store, where = _opened(path)
    folder, last = posixpath.split(where)
    info = store.get_file_info(where)
    if info.type == afs.FileType.File:
        return [path]
    if info.type == afs.FileType.Directory:
        folder, last = where, "*"
    found = store.get_file_info(afs.FileSelector(folder, allow_not_found=True))
    prefix = path[: len(path) - len(where)]
    return sorted(prefix + f.path for f in found if f.type == afs.FileType.File and fnmatch.fnmatch(f.base_name, last) and not f.base_name.startswith((".", "_")))


def _bytes(path: str) -> bytes:
    store, where = _opened(path)
    with store.open_input_stream(where) as f:
        return f.read()


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.path, self.start, self.end = path, start, end


class _SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.config = options["path"], _config(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _matching(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        plain = binary._plain(_bytes(partition.path))
        h = binary.snapshot_header(plain)
        if self.config:
            binary.check_header(h, self.config)
        for row in binary.decode_snapshot(plain):
            yield partition.path, row["seq"], row["id_type"], row["id"], binary._decoded(row, h["quantization"], h["dimensions"]), row["context"]


def _config(options: dict) -> CollectionConfig | None:
    return CollectionConfig(int(options["dimensions"]), options.get("quantization", "F32")) if "dimensions" in options else None


class SnapshotSource(DataSource):
    """Entries of snapshot files; option dimensions (with quantization) makes files of other settings an error."""

    @classmethod
    def name(cls) -> str:
        return "vcr"

    def schema(self) -> str:
        return SNAPSHOT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options)


def _changes(path: str, config: CollectionConfig, start: int = 0, end: int | None = None, marks: bool = True) -> Iterator[tuple]:
    for row in binary._log_rows(path, _bytes(path), False, config).itertuples(index=False):
        if row.pos >= start and (end is None or row.pos < end) and (marks or not row.truncated):
            number = lambda x: None if x is None or x != x else int(x)
            yield row.path, int(row.pos), number(row.sequence), row.op, row.id_key, number(row.id_type), row.id, row.embedding, row.context, bool(row.truncated)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.config = options["path"], _config(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _matching(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _changes(partition.path, self.config)


class _LogStream(DataSourceStreamReader):
    """Offsets are counts of valid records of each file; a checkpoint that starts a log again starts it from 0."""

    def __init__(self, options: dict):
        self.path, self.config = options["path"], _config(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: len(binary.decode_log(_bytes(p), self.config)[0]) for p in _matching(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p, 0 if n < start.get(p, 0) else start.get(p, 0), n) for p, n in end.items() if n != start.get(p, 0)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _changes(partition.path, self.config, partition.start, partition.end, marks=False)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Changes of log files in order of pos; a last row with truncated tells of a damaged tail. Needs option dimensions."""

    @classmethod
    def name(cls) -> str:
        return "vcrlog"

    def schema(self) -> str:
        return binary.LOG_ROW

    def _checked(self) -> dict:
        if "dimensions" not in self.options:
            raise FormatError("option dimensions is needed")
        return self.options

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self._checked())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(self._checked())

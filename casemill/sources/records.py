"""Records that hold newlines, read by byte ranges: a large file is many tasks.

A record begins behind a newline with one of a few words and a tab. It belongs to the range that its first byte lies in;
the range's task finds the first one by itself and reads past the range's end to finish the last one. So the records are the same
at any size of range, and a task holds one record and one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, CHUNK = 64 << 20, 1 << 20
#: Short ranges share a task: TASK_BYTES of them at most, and fewer where there would be less than LEAST_TASKS tasks.
TASK_BYTES, LEAST_TASKS = 32 << 20, 64


def records_between(file, start: int, end: int, words: tuple[str, ...], chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that begin at ``start`` or behind it and before ``end``, without the newline behind them.

    White space at the end of the file is no part of its last record.
    """
    pattern = re.compile(rb"\n(?:" + b"|".join(re.escape(w.encode()) for w in words) + rb")\t")
    longest = max(len(w.encode()) for w in words) + 1  # bytes of a match that may lie behind a buffer, less one
    base = max(start - 1, 0)  # a record at ``start`` has its newline before it
    file.seek(base)
    buffer, begun, looked = bytearray(), None, 0
    while True:
        if found := pattern.search(buffer, looked):
            at = base + found.start() + 1
            if begun is not None:
                yield begun, _without_newline(bytes(buffer[begun - base : found.start()]))
            if at >= end:
                return
            del buffer[: at - base]
            base = begun = at
            looked = 0
            continue
        looked = max(0, len(buffer) - longest)
        if begun is None:
            if base + looked >= end:  # a newline from here on belongs to a later range's record
                return
            del buffer[:looked]
            base, looked = base + looked, 0
        data = file.read(chunk)
        if not data:
            if begun is not None:
                yield begun, bytes(buffer).rstrip()
            return
        buffer += data


def _without_newline(record: bytes) -> bytes:
    return record[:-1] if record.endswith(b"\r") else record


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.words = tuple(w for w in options.get("starts", "UKSC|Tribunal").split("|") if w)
        self.size = max(1, int(options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[_Range]:
        files = list(_files(self.paths))
        ranges = sum(-(-size // self.size) for _, size in files)
        step = self.size * max(1, min(TASK_BYTES // self.size, ranges // LEAST_TASKS))
        return [_Range(path, at, min(at + step, size)) for path, size in files for at in range(0, size, step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple[str, int, str]]:
        if not partition.path:
            return
        system, path = file_system(partition.path)
        with system.open_input_file(path) as file:
            # the ranges of a task lie side by side and are read as one: a record belongs to the range of its first byte
            for at, record in records_between(file, partition.start, partition.end, self.words):
                yield partition.path, at, record.decode("utf-8", "replace")


def file_system(uri: str):
    """Arrow's file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _files(uris: list[str]) -> Iterator[tuple[str, int]]:
    """(address, bytes) of the files that are named or lie in the folders named; names that begin with "_" or "." are left out."""
    from pyarrow import fs

    for uri in uris:
        system, path = file_system(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        inside = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
        for each in sorted(inside, key=lambda i: i.path):
            if each.type == fs.FileType.File and not each.base_name.startswith(("_", ".")):
                yield head + each.path, each.size


class RecordSource(DataSource):
    """``spark.read.format("casemill_records").load("file:///folder,...")``: file, at (the record's first byte), record.

    Options: starts (the words that begin records, by "|") and rangeBytes, the bytes of a range; a task has one or, of short ones, several (``TASK_BYTES``).
    What stands before a file's first newline and word is no record. Files are opened by Arrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "casemill_records"

    def schema(self) -> str:
        return "file string, at long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)

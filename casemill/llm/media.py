"""Media columns behind a custom data source over archive directories.

Texts become 8-bit grey images (PNG, 576 samples a row), which tasks gather into archives of stored members
in a shared folder. The data source lists the archives and plans byte ranges over them; a range's task reads
its archive's directory, takes the members that begin in its range, and streams their bytes in Arrow batches.
Every member is read on its own from its offset, checked, and on failure read again from there.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from casemill.llm.shared import fresh_path, ship_package, text_of

ROW = 576
PAD = 255
#: Media bytes of one archive, and of one Arrow batch; larger members stand alone.
ARCHIVE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
ATTEMPTS = 4
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SOURCE_NAME = "casemill_archive"
SOURCE_SCHEMA = "archive string, offset long, member string, media binary"


# ---- the stored form -------------------------------------------------------------------------------


def payload_of(text: str) -> bytes:
    """UTF-8 with bytes 255 up to a positive multiple of 576; no UTF-8 text holds that byte."""
    data = text.encode()
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), bytes([PAD]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image whose samples are the payload."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that :func:`to_png` made; ValueError for anything else."""
    if not media.startswith(PNG_HEAD):
        raise ValueError("not a PNG image")
    at, height, data = len(PNG_HEAD), None, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if (width, *rest) != (ROW, 8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit grey image of the expected width")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, and the share of each eighth of the sample range, rounded: equal payloads, equal features."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 5, minlength=8) / len(samples)
    return f"mean={samples.mean():.4f};dev={samples.std():.4f};hist=" + ",".join(f"{s:.4f}" for s in shares)


# ---- archives --------------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write every row's text as a member named by its id; returns the number of members.

    An archive is named by its task's number, written aside and moved into place, so a task that runs again
    replaces its own archives. A task holds one archive in memory.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        task, members, archives = context.partitionId(), 0, 0
        buffer, file = None, None

        def close() -> None:
            nonlocal buffer, file, archives
            file.close()
            name = f"{root}/part-{task:06d}-{archives:05d}.zip"
            aside = f"{root}/_writing-{task:06d}-{context.taskAttemptId()}"
            with filesystem.open_output_stream(aside) as out:
                out.write(buffer.getbuffer())
            filesystem.move(aside, name)
            buffer, file, archives = None, None, archives + 1

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                media = to_png(payload_of(text.as_py()))
                if file is not None and buffer.tell() + len(media) > archive_bytes:
                    close()
                if file is None:
                    buffer = io.BytesIO()
                    file = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                key = key.as_py()
                name = f"{members:010d}/" + ("" if key is None else f"id-{key}") + ".png"
                file.writestr(zipfile.ZipInfo(name), media)
                members += 1
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64())})

    total = source.mapInArrow(run, "members long").agg(F.sum("members").alias("n")).first()["n"]
    return int(total or 0)


@dataclass
class ByteRange(InputPartition):
    """Members of one archive whose headers begin in [start, stop)."""

    archive: str
    size: int
    start: int
    stop: int

    def __init__(self, archive: str, size: int, start: int, stop: int):
        self.archive, self.size, self.start, self.stop = archive, size, start, stop


#: What a damaged or cut-off read of an archive raises.
READ_ERRORS = (OSError, EOFError, struct.error, zipfile.BadZipFile)


def retried(read: Callable[[], Any], what: str, attempts: int = ATTEMPTS, wait_s: float = 0.2) -> Any:
    """``read()``, again after a growing wait while it fails on the archive's bytes; OSError after the last attempt."""
    for attempt in range(1, attempts):
        try:
            return read()
        except READ_ERRORS:
            time.sleep(wait_s * 2 ** (attempt - 1))
    try:
        return read()
    except READ_ERRORS as error:
        raise OSError(f"{what}: {error}, {attempts} attempts") from error


def read_member(open_file, entry: zipfile.ZipInfo, attempts: int = ATTEMPTS, wait_s: float = 0.2) -> bytes:
    """One stored member by its offset, its header and checksum verified; read again, alone, if that fails."""

    def read() -> bytes:
        with open_file() as file:
            file.seek(entry.header_offset)
            head = file.read(30)
            if len(head) < 30 or head[:4] != b"PK\x03\x04":
                raise OSError("no member at this offset")
            names, extra = struct.unpack_from("<HH", head, 26)
            file.seek(entry.header_offset + 30 + names + extra)
            data = file.read(entry.compress_size)
        if len(data) != entry.file_size or zlib.crc32(data) != entry.CRC:
            raise OSError("damaged member")
        return data

    return retried(read, f"{entry.filename} at {entry.header_offset}", attempts, wait_s)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the sizes of the archives: planning reads no member and no archive's directory."""
        filesystem, root = _filesystem(self.folder)
        listed = filesystem.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        archives = sorted((f.path, f.size) for f in listed if f.path.endswith(".zip"))
        return [
            ByteRange(path, size, start, min(size, start + self.range_bytes))
            for path, size in archives
            for start in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        filesystem, _ = _filesystem(self.folder)

        def open_file():
            return filesystem.open_input_file(partition.archive)

        def directory() -> list[zipfile.ZipInfo]:
            with open_file() as file, zipfile.ZipFile(file) as archive:
                return [e for e in archive.infolist() if partition.start <= e.header_offset < partition.stop]

        entries = retried(directory, f"directory of {partition.archive}", self.attempts)
        names = ["archive", "offset", "member", "media"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, held = [], 0
        for entry in entries:
            media = read_member(open_file, entry, self.attempts)
            rows.append((partition.archive, entry.header_offset, entry.filename, media))
            held += len(media)
            if held >= self.batch_bytes:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class ArchiveSource(DataSource):
    """``spark.read.format("casemill_archive").load(folder)``: one row for each member of the folder's archives."""

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return SOURCE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Members of all archives of ``folder``; an empty or missing folder gives no rows."""
    ship_package(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(SOURCE_NAME).options(**options).load(folder)


def media_features(media: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """Per member: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = value.as_py()
                payload = from_png(stored)
                key = name.partition("/")[2].removesuffix(".png")
                end = payload.find(bytes([PAD]))
                rows.append(
                    (
                        key.removeprefix("id-") if key else None,
                        len(payload) if end < 0 else end,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(stored),
                        hashlib.sha256(stored).hexdigest(),
                        feature_of(payload),
                    )
                )
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=arrow)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))
    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = media.select("member", "media").mapInArrow(run, schema)
    return found.select(F.col("id").cast(id_type).alias(id_col), *names[1:])


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in archives of the shared folder and return :func:`media_features` of what is read back.

    Null texts are empty (576 bytes 255); null ids come back null; repeated rows are members of their own;
    an empty table gives no rows; other columns are ignored. No shuffle.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return media_features(read_archives(spark, folder), id_col, docs.schema[id_col].dataType.simpleString())

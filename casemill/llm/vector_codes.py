"""Compression of vectors to codes by integer product quantisation.

Components become integers, vectors are cut into parts, and each part is coded by the nearest entry of its position's
codebook. Codebooks are improved in rounds: columnar blocks of parts are an RDD; each task accumulates squared distances
dimension by dimension, adds its parts to int64 tensors of sums and counts with ``np.add.at``, and the tensors are merged
through a reduction tree (``treeAggregate``). What travels is the codebooks and one pair of tensors a task, whatever the
number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import remove, ship_package, tidied, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block; vectors whose distances to all entries are held at a time.
BLOCK, CHUNK = 4096, 1024
#: Components beyond this are refused: squared distances of 64 components of such size still fit into 64 bits.
LARGEST = float(1 << 18)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every vector that is kept.

    Rows whose vector is null or empty or holds null or non-finite components are dropped. Codebooks begin with the vectors
    of the smallest ids (null ids last, equal ids by their vectors); with fewer vectors than entries they are smaller.
    Repeated rows are vectors of their own, null labels are one label, null ids are kept; other columns are not looked at.
    An empty table gives no rows. Vectors of different lengths, a length that ``parts`` doesn't divide, and components beyond
    2 ** 18 raise a ValueError, as they have no common codebook or no exact distance.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    label_type = vectors.schema[label_col].dataType.simpleString()
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    kept = kept.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    least, most, widest = kept.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if least is not None and (least != most or least % parts or widest > LARGEST):
        raise ValueError(f"vectors of {least} to {most} components up to {widest} can't be cut into {parts} equal parts and coded exactly")
    blocks, path = written(spark, packed(kept, label_type), "vector-blocks")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # the codebooks' first entries
    books = np.array([np.floor(SCALE * np.array(row[0])) for row in first], np.int64).reshape(len(first), parts, (least or 0) // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = improved(blocks, books)
    coded, _ = written(spark, assigned(blocks, books, label_type), "vector-codes")
    remove(spark, path)
    sums, _ = written(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")
    met = coded.join(sums, coded["label"].eqNullSafe(sums["label"]))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def packed(kept: DataFrame, label_type: str) -> DataFrame:
    """Vectors in columnar blocks: ids, labels, and the integer components, one dimension after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                ids, vectors, labels = (column.slice(start, BLOCK) for column in batch.columns)
                flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                values = np.ascontiguousarray(np.floor(SCALE * flat).astype(np.int32).T)
                arrays = [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)), pa.array([len(ids)], pa.int64()), pa.array([values.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "labels", "n", "values"])

    return kept.mapInArrow(run, f"ids array<bigint>, labels array<{label_type}>, n bigint, values binary")


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (entry, dimension) for each column of ``values`` (dimension, vector), and its squared distance.

    Distances accumulate dimension by dimension, in 32 bits where they are sure to fit; the first of equals is taken.
    """
    largest = int(max(np.abs(values).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if len(values) * (2 * largest) ** 2 < 1 << 31 else np.int64
    picks, least = np.empty(values.shape[1], np.int64), np.empty(values.shape[1], np.int64)
    for start in range(0, values.shape[1], CHUNK):
        part = values[:, start : start + CHUNK].astype(kind)
        total = np.zeros((part.shape[1], len(book)), kind)
        for dimension, own in zip(part, book.astype(kind).T, strict=True):
            apart = dimension[:, None] - own[None, :]
            total += apart * apart
        pick = total.argmin(axis=1)
        picks[start : start + CHUNK], least[start : start + CHUNK] = pick, total[np.arange(len(pick)), pick]
    return picks, least


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, dimension) after one round: each entry becomes its parts' floored mean; unused ones stay."""
    parts, entries, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def add(tensors: tuple[np.ndarray, np.ndarray], block: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = tensors
        values = np.frombuffer(bytes(block[1]), np.int32).reshape(parts, width, block[0])
        for at in range(parts):
            picks, _ = nearest(values[at], shared.value[at])
            np.add.at(sums[at], picks, values[at].T)
            np.add.at(counts[at], picks, 1)
        return sums, counts

    def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return one[0] + two[0], one[1] + two[1]

    zero = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    sums, counts = blocks.select("n", "values").rdd.map(tuple).treeAggregate(zero, add, merge, depth=3)
    used = counts > 0
    return np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)


def assigned(blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """id, label, code, error of each vector under ``books``."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels, n, values = (column[at] for column in batch.columns)
                whole = np.frombuffer(values.as_buffer(), np.int32).reshape(len(shared.value), -1, n.as_py())
                found = [nearest(part, book) for part, book in zip(whole, shared.value, strict=True)]
                codes = np.stack([picks for picks, _ in found], axis=1).astype(np.uint8)
                width = 2 * codes.shape[1]
                text = codes.tobytes().hex()
                error = np.sum([least for _, least in found], axis=0)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return blocks.mapInArrow(lambda batches: tidied(run(batches)), f"id bigint, label {label_type}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and dimension, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

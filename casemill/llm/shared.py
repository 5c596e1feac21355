"""Folders, written tables and name hygiene shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.session import ship_package  # noqa: F401  for the operators here

#: Text words: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); on a local master a temporary one where it is unset, as in tests.

    On a cluster the setting is needed: executors don't see each other's temporary folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="casemill-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/casemill-{tag}-{uuid.uuid4().hex}"


def written(spark: SparkSession, frame: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``frame`` written as Parquet in the shared folder and read again, with its path: lineage ends here."""
    path = fresh_path(spark, tag)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return a Python worker's free memory to the system: idle workers outlive their stage and count for their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task's function, with :func:`give_back` when it ends."""
    try:
        yield from batches
    finally:
        give_back()


#: Bits of a filter at most: 16 MB are broadcast, however many keys there are.
FILTER_BITS = 1 << 27
_CHUNK = 32768


def only_possible(frame: DataFrame, key: Column, wanted: DataFrame, count: int) -> DataFrame:
    """The rows of ``frame`` whose 64-bit ``key`` may be among the ``count`` keys of ``wanted`` (one column), before anything is shuffled.

    A bitmap of the wanted keys' residues is broadcast; its size is bounded by FILTER_BITS. No wanted row is lost;
    others pass too, the more the fuller the bitmap is, so an exact join or grouping must follow.
    """
    bits = max(_CHUNK, min(FILTER_BITS, 1 << (64 * max(1, count) - 1).bit_length()))

    def slot(hashed: Column) -> list[Column]:
        place = F.pmod(hashed, F.lit(bits))
        return [F.floor(place / _CHUNK).alias("__chunk"), (place % _CHUNK).alias("__bit")]

    # one row a key goes to its chunk's task, so partial bitmaps don't travel
    bitmap = wanted.select(*slot(F.col(wanted.columns[0]))).repartition("__chunk").groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    met = frame.select("*", *slot(key)).join(F.broadcast(bitmap), "__chunk")
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.expr("shiftleft(1, int(__bit % 8))").bitwiseAND(byte) != 0
    return met.where(has).select(*[met[c] for c in frame.columns])


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

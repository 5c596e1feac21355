"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every text is hashed to 64 bits; (id, digest, hash) are written to the shared folder.
2. Senders read their own part of these hashes, without a shuffle, in blocks of a bounded number of rows. A block becomes one row: for
   every owner (a range of hash values) the Golomb-Rice code of the gaps between its sorted hashes. Only codes travel.
3. An owner merges what it got and returns to each block a bitmap of the hashes seen more than once; a block's row meets its
   bitmaps and gives the hashes of suspects.
4. A bitmap of these, bounded in size, lets the scan pass the suspects' texts (and few others) to the shuffle; the texts of
   a digest are compared byte by byte, and digests whose texts differ are grouped by the text itself.

What an owner holds is bounded by the number of owners, which follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import only_possible, remove, ship_package, text_of, tidied, written

#: Hashes an owner sees on average; sets the number of owners.
ROWS_PER_OWNER = 1_000_000
#: Rows of one block.
BLOCK_ROWS = 100_000


def rice_encode(gaps: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice code of non-negative gaps with divisor 2**shift: the quotients in unary, each ended by a zero, and behind them the remainders' bits."""
    if not gaps.size:
        return b""
    gaps = gaps.astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places[None, :]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(coded: bytes, count: int, shift: int) -> np.ndarray:
    """The gaps behind :func:`rice_encode`."""
    if not count:
        return np.empty(0, np.uint64)
    rest_bytes = -(-count * shift // 8)
    data = np.frombuffer(coded, np.uint8)
    unary, rest = data[: len(data) - rest_bytes], data[len(data) - rest_bytes :]
    stops = np.flatnonzero(np.unpackbits(unary) == 0)[:count]  # zeros behind the last one fill its byte
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(shift)
    bits = np.unpackbits(rest)[: count * shift].reshape(count, shift)
    for place in range(shift):
        gaps |= bits[:, place].astype(np.uint64) << np.uint64(shift - 1 - place)
    return gaps


def rice_shift(span: int, count: int) -> int:
    """The divisor's bits for ``count`` values spread over ``span``."""
    return max(0, (max(1, span // max(1, count))).bit_length() - 1)


def _span(owners: int) -> int:
    """Hash values of one owner; a single one would have more than 64 bits can count."""
    return (1 << 64) // max(2, owners) + 1


def sealed(hashes: np.ndarray, owners: int) -> list[dict]:
    """One block's messages: per owner its sorted distinct hashes, coded, and which of them the block repeats."""
    span = _span(owners)
    values, counts = np.unique(hashes.view(np.uint64), return_counts=True)
    owner = (values // np.uint64(span)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    out = []
    for start, stop in zip(cuts, [*cuts[1:], len(owner)], strict=True):
        part = values[start:stop] - np.uint64(int(owner[start]) * span)
        shift = rice_shift(span, len(part))
        coded = rice_encode(np.diff(part, prepend=np.uint64(0)), shift)
        out.append({"owner": int(owner[start]), "n": len(part), "shift": shift, "coded": coded, "again": np.packbits(counts[start:stop] > 1).tobytes()})
    return out


_MESSAGES = "array<struct<owner:long,n:long,shift:int,coded:binary,again:binary>>"
_MESSAGE = pa.list_(pa.struct([("owner", pa.int64()), ("n", pa.int64()), ("shift", pa.int32()), ("coded", pa.binary()), ("again", pa.binary())]))


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, block = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sealed(np.concatenate(held), owners)], _MESSAGE)], ["block", "messages"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield row()
                held, rows, block = [], 0, block + 1
        if rows:
            yield row()

    return run


def _reply(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner's answer: per block a bitmap of its hashes that some other row has too."""
    parts = [
        np.cumsum(rice_decode(coded, n, shift), dtype=np.uint64)
        for coded, n, shift in zip(sent["coded"], sent["n"], sent["shift"], strict=True)
    ]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[counts > 1]
    bitmaps = []
    for part, again in zip(parts, sent["again"], strict=True):
        own = np.unpackbits(np.frombuffer(again, np.uint8))[: len(part)].astype(bool)
        bitmaps.append(np.packbits(own | np.isin(part, shared)).tobytes())
    return pd.DataFrame({"owner": sent["owner"], "block": sent["block"], "n": sent["n"], "bitmap": bitmaps})


def _suspects(owners: int):
    span = _span(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's distinct hashes whose bit is set."""
        for batch in batches:
            for at in range(batch.num_rows):
                replies = {r["owner"]: r["bitmap"] for r in batch.column(1)[at].as_py()}
                found = [np.empty(0, np.uint64)]
                for part in batch.column(0)[at].as_py():
                    values = np.cumsum(rice_decode(part["coded"], part["n"], part["shift"]), dtype=np.uint64) + np.uint64(part["owner"] * span)
                    found.append(values[np.unpackbits(np.frombuffer(replies[part["owner"]], np.uint8))[: part["n"]].astype(bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["hash"])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    owners: int | None = None,
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256; of equal texts the row with the largest id stays.

    ``normalise`` is a column expression over ``docs`` (default: the text unchanged); null texts are empty
    and equal to other empty texts. Null ids sort below all others; of rows that repeat an id and a text
    every copy with the largest id is marked kept and all count in group_size. An empty table gives no
    rows; other columns are ignored. Groups are summed before they are shuffled, so a group of a third of
    all rows sends one row a task, and no list of members is built.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = text_of(normalise if normalise is not None else text_col)
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = source.select("id", _digest(F.col("text")).alias("digest"), _hash(F.col("text")).alias("hash"))
    prints, _ = written(spark, hashed, "fingerprints")
    if owners is None:
        owners = max(spark.sparkContext.defaultParallelism, -(-prints.count() // ROWS_PER_OWNER))
    send, mark = _send(owners), _suspects(owners)
    blocks, blocks_path = written(spark, prints.select("hash").mapInArrow(lambda batches: tidied(send(batches)), f"block long, messages {_MESSAGES}"), "blocks")
    sent = blocks.select("block", F.inline("messages"))
    replies = sent.groupBy("owner").applyInPandas(_reply, "owner long, block long, n long, bitmap binary")
    gathered = replies.groupBy("block").agg(F.collect_list(F.struct("owner", "bitmap")).alias("replies"))  # a bit for each of a block's hashes
    marks = blocks.join(gathered, "block").select("messages", "replies").mapInArrow(lambda batches: tidied(mark(batches)), "hash long")
    marks, marks_path = written(spark, marks.distinct(), "suspects")
    remove(spark, blocks_path)
    suspects = only_possible(source, _hash(F.col("text")), marks, marks.count())
    # a digest's rows are summed, and equal texts become one, before they are shuffled
    groups = suspects.groupBy(_digest(F.col("text")).alias("digest"), _hash(F.col("text")).alias("hash")).agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.collect_set("text").alias("texts")
    )
    groups = groups.where("group_size > 1").select("digest", "hash", "keep_id", "group_size", (F.size("texts") == 1).alias("same"))
    groups, _ = written(spark, groups, "groups")
    remove(spark, marks_path)
    plain = prints.join(groups.where("same").drop("same"), ["digest", "hash"], "left").select("id", "digest", "hash", "keep_id", "group_size")
    clashing = groups.where(~F.col("same")).select("digest", "hash")
    if not clashing.isEmpty():  # different texts of one digest and hash: group by the text itself
        theirs = source.withColumns({"digest": _digest(F.col("text")), "hash": _hash(F.col("text"))}).join(clashing, ["digest", "hash"], "left_semi")
        exact = theirs.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        plain = plain.join(clashing, ["digest", "hash"], "left_anti").unionByName(
            theirs.join(exact, "text").select("id", "digest", "hash", "keep_id", "group_size")
        )
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return plain.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

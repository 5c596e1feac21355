"""Ranked lexical search as a blocked sparse matrix product.

The item-term matrix holds how often an item names a term, the term-document matrix int64 impacts. Documents are
indexed once, in blocks of columns: each block lists the terms that items may name with their documents and counts.
Items are packed into blocks of rows with their terms' weights. Every block of the one meets every block of the other (a
stated query set against all rows) and is multiplied by Gustavson's method: the rows of an item's terms are scaled, put one
after the other and merged by document with numpy. A task keeps the k best documents of each item over all blocks it has
seen; only those are shuffled and reduced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.shared import FILTER_BITS, remove, ship_package, text_of, tidied, written

#: Terms: maximal runs of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of UTF-8 bytes: those of terms, A-Z lower-cased, and a blank for all others.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents and entries of one block of columns, items of one block of rows, products that are merged at a time.
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_ITEMS, CHUNK = 4096, 1 << 18, 256, 1 << 21
#: Bits of a piece of the filter of named terms.
_PIECE = 32768

_INDEX = "docs array<bigint>, lengths array<bigint>, terms array<string>, held array<bigint>, starts binary, places binary, counts binary, n_docs bigint, n_terms bigint"
_ITEMS = "items array<bigint>, terms array<string>, starts binary, columns binary, weights binary"


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0, equal scores by rising id.

    Null and empty texts have no terms and don't count as documents; each row of ``docs`` is a document of its own, so
    repeated rows are ranked each; null ids come first among equals. Rows that share an item id are one item with the terms
    of all of them; items without terms in any document have no rows. Whole texts of any length are read. Empty tables
    give no rows. Ids are integers; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named, named_path = written(spark, item_terms(items, item_col, item_text), "search-terms")
    index, index_path = written(spark, indexed(docs, term_filter(named), id_col, text_col), "search-index")
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = totals[0], totals[1]
    rows, _ = written(spark, item_blocks(weighted(spark, named, index, n_docs)), "search-items")
    remove(spark, named_path)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for at in range(batch.num_rows):
                best.add(*product({name: column[at] for name, column in zip(batch.schema.names, batch.columns, strict=True)}, n_docs, n_terms))
            best.cut()
        yield best.batch()

    met = index.drop("held", "n_docs", "n_terms").crossJoin(rows.withColumnsRenamed({c: f"i_{c}" for c in rows.columns}))  # a stated query set against all rows, in blocks
    found = met.mapInArrow(lambda batches: tidied(multiply(batches)), "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, term, times: the item-term matrix."""
    lowered = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def term_filter(named: DataFrame) -> np.ndarray:
    """Bits at the CRC-32 residues of all terms that items name: at most FILTER_BITS (16 MB), however many terms there are.

    It only spares the index terms that no item names; others that share a residue are indexed too and never asked for.
    """
    bits = max(_PIECE, min(FILTER_BITS, 1 << (64 * max(1, named.count()) - 1).bit_length()))
    place = F.crc32(F.encode("term", "UTF-8")) % bits
    pieces = named.select(F.floor(place / _PIECE).alias("piece"), (place % _PIECE).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    whole = np.zeros(bits // 8, np.uint8)
    for piece, bitmap in pieces.collect():  # at most FILTER_BITS / _PIECE pieces of 4 KB
        whole[piece * _PIECE // 8 : (piece + 1) * _PIECE // 8] = np.frombuffer(bitmap, np.uint8)
    return whole


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, lower-cased."""
    return text.translate(_KEPT).split()


def indexed(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """The term-document matrix in blocks: terms that may be named, by term the documents' places and counts; and what all documents hold.

    ``docs`` and ``lengths`` list the block's documents by rising id (null first), so places order them by id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value, len(shared.value) * 8
        held: list[tuple[int | None, int, list[tuple[bytes, int]]]] = []
        n_docs = n_terms = entries = 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda d: (d[0] is not None, d[0] or 0))
            numbers: dict[bytes, int] = {}
            terms, places, counts = (np.empty(entries, t) for t in (np.int64, np.int32, np.int64))
            at = 0
            for place, (_, _, kept) in enumerate(held):
                for term, times in kept:
                    terms[at], places[at], counts[at] = numbers.setdefault(term, len(numbers)), place, times
                    at += 1
            order = np.argsort(terms, kind="stable")
            widths = np.bincount(terms, minlength=len(numbers))
            starts = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
            one = lambda value, kind: pa.array([value], kind)
            columns = [one([d[0] for d in held], pa.list_(pa.int64())), one([d[1] for d in held], pa.list_(pa.int64())), one([t.decode() for t in numbers], pa.list_(pa.string())), one(widths, pa.list_(pa.int64())),
                       one(starts.tobytes(), pa.binary()), one(places[order].tobytes(), pa.binary()), one(counts[order].tobytes(), pa.binary()), one(n_docs, pa.int64()), one(n_terms, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["docs", "lengths", "terms", "held", "starts", "places", "counts", "n_docs", "n_terms"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(found)
                counted = Counter(found)
                residues = np.fromiter((zlib.crc32(t) for t in counted), np.int64, len(counted)) % bits
                hit = (bitmap[residues >> 3] >> (residues & 7)) & 1
                kept = [pair for pair, yes in zip(counted.items(), hit.tolist(), strict=True) if yes]
                if kept:
                    held.append((key, len(found), kept))
                    entries += len(kept)
                if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield block()
                    held.clear()
                    n_docs = n_terms = entries = 0
        if n_docs:
            yield block()

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(lambda batches: tidied(run(batches)), _INDEX)


def weighted(spark: SparkSession, named: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item_id, term, weight: how often the item names the term times floor(1000 * ln((2 N + 2) / (2 df + 1))).

    The documents of each term are counted by block first, so a term has one row a block; terms that no document holds go.
    """
    by_block = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("held").alias("held"))).alias("x")).select("x.*")
    found, _ = written(spark, by_block.groupBy("term").agg(F.sum("held").alias("df")), "search-df")
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    return named.join(found, "term").select("item_id", "term", (F.col("times") * weight).alias("weight"))


def item_blocks(entries: DataFrame) -> DataFrame:
    """The item-term matrix in blocks of at most BLOCK_ITEMS rows: items, the block's terms, and by item columns and weights."""
    whole = entries.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))  # an item's own terms

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ITEMS):
                items, terms, weights = (column.slice(first, BLOCK_ITEMS) for column in batch.columns)
                unique = terms.flatten().dictionary_encode()
                starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                columns, scaled = (a.to_numpy(zero_copy_only=False) for a in (unique.indices, weights.flatten()))
                arrays = [pa.array([items.to_pylist()], pa.list_(pa.int64())), pa.array([unique.dictionary.to_pylist()], pa.list_(pa.string()))]
                arrays += [pa.array([x.tobytes()], pa.binary()) for x in (starts, columns.astype(np.int32), scaled.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["items", "terms", "starts", "columns", "weights"])

    return whole.mapInArrow(pack, _ITEMS)


def product(row: dict[str, pa.Scalar], n_docs: int, n_terms: int) -> tuple[np.ndarray, ...]:
    """Items, whether their id is null, documents, whether null, and scores: one block of items times one block of documents."""
    numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    docs, items = (row[name].values for name in ("docs", "i_items"))
    starts, places, counts = numbers("starts", np.int64), numbers("places", np.int32), numbers("counts", np.int64)
    i_starts, i_columns, i_weights = numbers("i_starts", np.int64), numbers("i_columns", np.int32), numbers("i_weights", np.int64)
    # impacts of the block's entries
    lengths = row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    measure = 25 + (75 * lengths * n_docs) // n_terms if n_terms else lengths
    impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * measure[places])
    # each of the items' terms to its row of the block; -1 where the block lacks it
    here = {term: at for at, term in enumerate(row["terms"].values.to_pylist())}
    rows = np.array([here.get(term, -1) for term in row["i_terms"].values.to_pylist()], np.int64)[i_columns] if len(i_columns) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(items)), np.diff(i_starts))
    there = rows >= 0
    rows, owner, weights = rows[there], owner[there], i_weights[there]
    widths = starts[rows + 1] - starts[rows]
    ends = np.cumsum(widths)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    first, n = 0, np.int64(max(1, len(docs)))
    while first < len(rows):  # whole items, about CHUNK products at a time
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")), first + 1)
        last = int(np.searchsorted(owner, owner[last - 1], "right"))
        wide = widths[first:last]
        offsets = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        entry = np.repeat(starts[rows[first:last]], wide) + offsets
        keys = np.repeat(owner[first:last], wide) * n + places[entry]
        values = np.repeat(weights[first:last], wide) * impacts[entry]
        order = np.argsort(keys, kind="stable")  # merges an item's rows by document
        keys, values = keys[order], values[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        if len(edges):
            out.append((keys[edges], np.add.reduceat(values, edges)))
        first = last
    keys, scores = (np.concatenate([o[n] for o in out]) if out else np.empty(0, np.int64) for n in (0, 1))
    good = scores > 0
    keys, scores = keys[good], scores[good]
    which, place = keys // n, keys % n
    plain = lambda values: (values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_null().to_numpy(zero_copy_only=False))
    (item, item_null), (doc, doc_null) = plain(items), plain(docs)
    return item[which], item_null[which], doc[place], doc_null[place], scores


class Best:
    """The k best documents of each item so far."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(self._cut(columns))

    def _cut(self, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        item, item_null, doc, doc_null, score = columns
        order = np.lexsort((doc, ~doc_null, -score, item, item_null))
        item, item_null = item[order], item_null[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (item_null[1:] != item_null[:-1])]) if len(item) else np.empty(0, bool)
        begins = np.flatnonzero(new)
        place = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
        kept = order[place < self.k]
        return tuple(column[kept] for column in columns)

    def cut(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._cut(tuple(map(np.concatenate, zip(*self.parts, strict=True))))]

    def batch(self) -> pa.RecordBatch:
        self.cut()
        item, item_null, doc, doc_null, score = self.parts[0] if self.parts else tuple(np.empty(0, t) for t in (np.int64, bool, np.int64, bool, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64(), mask=item_null), pa.array(doc, pa.int64(), mask=doc_null), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

"""Token counts by heap-and-linked-list byte-pair merging over a piece vocabulary.

The count of a segment is its number of initial symbols minus the merges applied; no identifiers are
produced. The adjacent pair of lowest rank is popped from a heap, joined in a doubly linked list and
its two new neighbours are pushed, so a segment of n symbols costs O(n log n) however long it is.

Segments: a vocabulary whose pieces carry the word mark only in front never merges across the start of
a run of marks, so texts are cut there without changing any count (checked when a model is loaded).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import ship_package, text_of

MARK = "▁"
#: Piece kinds of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a worker's segment cache; beyond it segments are counted anew.
CACHE_ENTRIES = 250_000
CACHED_CHARS = 40


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one serialized message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        width = {1: 8, 5: 4}.get(kind)
        if width is None:
            width = varint()
        yield key >> 3, raw[at : at + width]
        at += width


class PieceModel:
    """Ranks of a byte-fallback BPE model file with identity normalisation."""

    def __init__(self, path: str):
        import struct

        pieces: list[tuple[str, float, int]] = []
        normalizer: dict[int, int | bytes] = {}
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL}
                piece.update(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1):
            raise ValueError("only identity normalisation with a dummy prefix and kept white space is supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):  # the library splits unused pieces again
            raise ValueError("models with user-defined or unused pieces are not supported")
        usable = [(text, score) for text, score, kind in pieces if kind == NORMAL]
        self.known = {text for text, _ in usable if len(text) == 1}
        order = sorted((p for p in usable if len(p[0]) > 1), key=lambda p: -p[1])
        self.rank = {text: at for at, (text, _) in enumerate(order)}
        for text in self.rank:
            if MARK in text.lstrip(MARK) or not self.known.issuperset(text):
                raise ValueError("a piece holds an inner word mark or a symbol outside the vocabulary")
        self.adjacent = {text[at : at + 2] for text in self.rank for at in range(len(text) - 1)}

    def merges(self, symbols: str) -> int:
        """Merges applied to one segment."""
        rank, size = self.rank, len(symbols)
        heap = [r * size + at for at in range(size - 1) if (r := rank.get(symbols[at : at + 2])) is not None]
        if not heap:
            return 0
        heapify(heap)
        part: list[str | None] = list(symbols)
        after, before, done = list(range(1, size + 1)), list(range(-1, size - 1)), 0
        while heap:
            r, left = divmod(heappop(heap), size)
            right = after[left]
            if part[left] is None or right >= size:
                continue
            joined = part[left] + part[right]
            if rank.get(joined) != r:
                continue  # one of the two has changed since
            done += 1
            part[left], part[right] = joined, None
            following = after[left] = after[right]
            if following < size:
                before[following] = left
                if (r := rank.get(joined + part[following])) is not None:
                    heappush(heap, r * size + left)
            if (previous := before[left]) >= 0 and (r := rank.get(part[previous] + joined)) is not None:
                heappush(heap, r * size + previous)
        return done

    def count(self, segment: str) -> int:
        """Tokens of one segment: symbols (bytes where the vocabulary lacks the character) minus merges."""
        symbols = len(segment)
        if not self.known.issuperset(segment):
            symbols = sum(1 if c in self.known else len(c.encode()) for c in segment)
        return symbols - self.merges(segment)


class TextCounter:
    """Counts whole texts, remembering short segments."""

    _segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, model: PieceModel, entries: int = CACHE_ENTRIES):
        class Memo(dict):
            def __init__(self, prefix: str):
                super().__init__()
                self.prefix = prefix

            def __missing__(self, word: str) -> int:
                if "\n" in word and "\n" not in model.known:
                    first, *rest = word.split("\n")
                    return self[first] + len(rest) + sum(map(inner.__getitem__, rest))
                if 1 < len(word) <= CACHED_CHARS and word[-2:] not in model.adjacent:  # no piece joins the last two
                    n = self[word[:-1]] + inner[word[-1]]
                else:
                    n = model.count(self.prefix + word)
                if len(self) < entries and len(word) <= CACHED_CHARS:
                    self[word] = n
                return n

        inner = Memo("")
        inner[""] = 0
        self._inner, self._marked = inner, Memo(MARK)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK not in text and "  " not in text and text[0] != " ":
            return sum(map(self._marked.__getitem__, text.split(" ")))
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self._inner.__getitem__, self._segments.findall(marked)))


_counters: dict[str, TextCounter] = {}


def counter(path: str) -> TextCounter:
    """The worker's counter for a model file, loaded once per process."""
    if path not in _counters:
        _counters[path] = TextCounter(PieceModel(path))
    return _counters[path]


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 tokens and 0 bytes; a null id is kept; repeated rows are counted each;
    an empty table gives no rows; other columns are ignored, whatever their names. ``model_path`` must be
    readable by every worker. A narrow plan: no shuffle, one text at a time in memory beside its batch.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("__text"))
    source = source.select(id_col, F.octet_length("__text").cast("long").alias("n_bytes"), "__text")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            counts = pa.array([count(text.as_py()) for text in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], [id_col, "n_bytes", "n_tokens"])

    counted = source.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

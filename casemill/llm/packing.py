"""Packing documents into fixed windows by the sum-of-squares rule.

A document's tokens are cut into full windows and a remainder. Each remainder goes whole to the fill level that
makes the sum of squared counts of partially filled windows smallest, where a level array holds how many windows stand at
each level and a window of level 0 is a new one: of the levels that can hold it, the one whose windows are many
while those at the level it leads to are few. Many windows stand open at a time; one leaves the array when a remainder fills it.
Documents are cut in two cases only: where they are longer than a window, and where open windows are closed,
which happens when a task ends or more than ``MOST_OPEN`` stand open. Then their pieces are strung together and cut
into full windows; what is left at a task's end is cut into sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import ship_package, text_of, tidied

WINDOW = 2048
END_ID = 1
#: Words a task remembers at most (some 200 MB), and a worker between tasks.
CACHE_ENTRIES, KEPT_ENTRIES = 1_000_000, 100_000
CACHED_CHARS = 40
#: Identifiers of one output batch, about.
OUT_TOKENS = 500_000
#: Bits of a sequence id below the task's number.
LOCAL_BITS = 36


#: Windows that a task holds open at most (some 32 MB of ids).
MOST_OPEN = 4096
_NEVER = np.int64(1) << 60


class Packer:
    """Windows of one task; ``put`` and ``flush`` return finished pieces (id, start, ids, tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window, np.int64)  # the level array: open windows at each level
        self.leave = np.full(window, _NEVER)  # what the sum of squares changes by if a window leaves a level
        self.reach = np.ones(window + 1, np.int64)  # and if one reaches it; a full window leaves the array
        self.reach[window] = 0
        self.at_level: list[list[list]] = [[] for _ in range(window)]
        self.open = 0
        self.next = first_sequence

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, size: int) -> int:
        """The level that holds an item of ``size`` and whose use leaves the smallest sum of squares; the fullest of equals."""
        costs = self.leave[1 : self.window - size + 1] + self.reach[1 + size :]
        if not len(costs):
            return 0
        best = len(costs) - 1 - int(costs[::-1].argmin())
        return best + 1 if costs[best] <= self.reach[size] else 0

    def _move(self, level: int, by: int) -> None:
        now = self.counts[level] = self.counts[level] + by
        self.leave[level] = 1 - 2 * now if now else _NEVER
        self.reach[level] = 2 * now + 1
        self.open += by

    def put(self, doc: object, ids: np.ndarray) -> list[tuple]:
        total, start, done = len(ids), 0, []
        while total - start >= self.window:
            done.append((doc, start, ids[start : start + self.window], total, self._sequence(), 0))
            start += self.window
        if start == total:
            return done
        level = self.level_for(total - start)
        pieces = []
        if level:
            pieces = self.at_level[level].pop()
            self._move(level, -1)
        pieces.append((doc, start, ids[start:], total))
        level += total - start
        if level == self.window:
            done += self._placed(pieces)
        else:
            self.at_level[level].append(pieces)
            self._move(level, 1)
            if self.open > self.most_open:
                done += self._closed()
        return done

    def _placed(self, pieces: list[tuple]) -> list[tuple]:
        """Pieces one behind the other in a sequence of their own."""
        done, sequence, offset = [], self._sequence(), 0
        for doc, start, ids, total in pieces:
            done.append((doc, start, ids, total, sequence, offset))
            offset += len(ids)
        return done

    def _closed(self) -> list[tuple]:
        """All open windows strung together, the fullest first, and cut into full ones; what is left stays open."""
        done, held, level = [], [], 0
        for windows in reversed(self.at_level):
            for doc, start, ids, total in (piece for pieces in windows for piece in pieces):
                while len(ids):
                    part = ids[: self.window - level]
                    held.append((doc, start, part, total))
                    ids, start, level = ids[len(part) :], start + len(part), level + len(part)
                    if level == self.window:
                        done += self._placed(held)
                        held, level = [], 0
            windows.clear()
        self.counts[:], self.leave[:], self.reach[:-1], self.open = 0, _NEVER, 1, 0
        if level:
            self.at_level[level].append(held)
            self._move(level, 1)
        return done

    def flush(self) -> list[tuple]:
        """Close all open windows; the last one is cut into sequences of falling powers of two."""
        done = self._closed()
        for level, windows in enumerate(self.at_level):
            for pieces in windows:
                left, held, room = level, [], 1 << (level.bit_length() - 1)
                for doc, start, ids, total in pieces:
                    while len(ids):
                        part = ids[:room]
                        held.append((doc, start, part, total))
                        ids, start, left, room = ids[len(part) :], start + len(part), left - len(part), room - len(part)
                        if not room:
                            done += self._placed(held)
                            held, room = [], 1 << (left.bit_length() - 1) if left else 0
                self._move(level, -1)
            windows.clear()
        return done


#: White space by any Unicode version's \s: more of it only sends more texts the slower way.
SPACE = r"\s\u180e"


#: Words that are one piece for the pre-tokenizer: Latin letters.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Words that the pre-tokenizer cuts before their marks: Latin letters, then ASCII marks other than the apostrophe.
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
#: Words that it cuts before and behind each newline: single ones, with something on either side.
LINES = re.compile(rf"[^{SPACE}]+(?:\n[^{SPACE}]+)+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (byte for byte in range(256) if byte not in plain)
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + n) for n, byte in enumerate(others)}


class Encoder:
    """Identifiers of whole texts as little-endian 32-bit bytes; words are remembered.

    Texts are cut before single blanks, where the vocabulary's pre-tokenizer cuts too unless the blank stands
    inside a run of white space (with white space, or a token of the library's own, behind it); texts with such
    a blank are encoded whole. New words are cut where it surely cuts as well: at single newlines, and between
    letters and marks; Latin letters go to the library's model without its other steps. So the concatenation equals
    the text's own encoding, for byte-level vocabularies without a normaliser (others are refused).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.normalizer is not None or "ByteLevel" not in str(library.pre_tokenizer) or "add_prefix_space=True" in str(library.pre_tokenizer):
            raise ValueError("only byte-level vocabularies without normaliser or prefix are supported")

        merge, written = library.model.tokenize, byte_letters()

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def encode(text: str) -> bytes:
            return packed(library.encode(text, add_special_tokens=False).ids)

        class Memo(dict):
            """Identifiers of words behind a prefix; of a new word only what its parts don't give is encoded."""

            def __init__(self, prefix: str):
                self.prefix, self.start = prefix, prefix.translate(written)

            def __missing__(self, word: str) -> bytes:
                if "\n" in word and LINES.fullmatch(word):
                    first, *rest = word.split("\n")
                    return self[first] + b"".join([newline + inner[line] for line in rest])
                if LATIN.fullmatch(word):  # one piece: the library's model alone does
                    letters = self.start + (word if word.isascii() else word.encode().decode("latin-1").translate(written))
                    ids = packed([token.id for token in merge(letters)])
                elif parts := MARKED.fullmatch(word):
                    ids = self[parts[1]] + marks[parts[2]]
                else:
                    ids = encode(self.prefix + word)
                if len(self) < CACHE_ENTRIES and len(word) <= CACHED_CHARS:
                    self[word] = ids
                return ids

        own = [re.escape(token.content) for token in library.get_added_tokens_decoder().values()]
        self._inside = re.compile(rf"[{SPACE}] (?:{'|'.join([f'[{SPACE}]', *own])})").search
        newline, inner, marks = encode("\n"), Memo(""), Memo("")
        self._encode, self._memo, self._memos = encode, Memo(" "), (inner, marks)

    def forget(self) -> None:
        """Keep the words that came first, which are the frequent ones."""
        for memo in (self._memo, *self._memos):
            kept = list(islice(memo.items(), KEPT_ENTRIES))
            memo.clear()
            memo.update(kept)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " " or self._inside(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._memo.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Null and empty texts are the end id alone; null ids are kept; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored. A narrow plan: every task packs the rows it reads, so
    nothing is shuffled and a lost task is packed anew with the same sequence ids.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << LOCAL_BITS, window)
        tail = np.array([end_id], "<u4").tobytes()
        id_arrow = None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [
                pa.array([p[0] for p in pieces], id_arrow),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
                *(pa.array([p[at] for p in pieces], pa.int64()) for at in (3, 4, 5)),
            ]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([p[2].astype(np.int64).tolist() for p in pieces], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            done, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py()) + tail, "<u4")
                done += packer.put(doc, ids)
                held += len(ids)
                if held > OUT_TOKENS:
                    yield table(done)
                    done, held = [], 0
            yield table(done)
        if id_arrow is not None:
            yield table(packer.flush())
        encode.forget()

    schema = f"`{id_col}` {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(lambda batches: tidied(run(batches)), schema + (", ids array<long>" if with_ids else ""))

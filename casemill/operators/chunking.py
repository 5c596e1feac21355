"""Chunks of bounded length from a document's paragraphs; a document is one row, so no group is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as tx

TARGET, LEAST, MOST = 1000, 800, 1200
EVEN_TARGET, EVEN_LEAST, EVEN_MOST, EVEN_MERGE = 600, 300, 1200, 1250
#: Documents that a task cuts at a time.
ROWS = 64


#: A paragraph and, of long ones only, its sentences.
Part = tuple[str, list[str]]


def _fill(parts: list[str], most: int) -> list[str]:
    """Parts joined in order into runs of at most ``most`` characters; a longer part stands alone."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) + 1 < most:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def packed(parts: list[Part]) -> list[str]:
    """Long paragraphs are cut at sentences; short ones are merged until TARGET is reached, never over MOST."""
    out: list[str] = []
    waiting = ""
    for part, sentences in parts:
        if len(part) > MOST:
            out += [waiting] * bool(waiting) + _fill([s for s in sentences if len(s) >= 10], MOST)
            waiting = ""
            continue
        if waiting and len(waiting) + 1 + len(part) + 1 > MOST:
            out.append(waiting)
            waiting = ""
            if len(part) >= LEAST:
                out.append(part)
                continue
        waiting = f"{waiting} {part}" if waiting else part
        if len(waiting) + 1 >= TARGET:
            out.append(waiting)
            waiting = ""
    return out + [waiting] * bool(waiting)


def even(parts: list[Part]) -> list[str]:
    """Cut over EVEN_MOST at sentences (a longer sentence at words), merge towards EVEN_TARGET, then join what is still short."""
    pieces: list[str] = []
    for part, sentences in parts:
        if len(part) <= EVEN_MOST:
            pieces.append(part)
            continue
        for sentence in _fill(sentences, EVEN_TARGET):
            pieces += _fill(sentence.split(), EVEN_MOST) if len(sentence) > EVEN_MOST else [sentence]
    merged: list[str] = []
    for piece in pieces:
        if merged and len(merged[-1]) < EVEN_TARGET and len(merged[-1]) + 1 + len(piece) <= EVEN_MOST:
            merged[-1] += " " + piece
        else:
            merged.append(piece)
    out: list[str] = []
    for piece in merged:
        if out and min(len(piece), len(out[-1])) < EVEN_LEAST and len(out[-1]) + 1 + len(piece) <= EVEN_MERGE:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def _chunks(df: DataFrame, cut, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # few documents are Python objects at a time
                part = batch.slice(start, ROWS)
                chunks = [cut([(p["text"], p["sentences"]) for p in parts]) for parts in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chunks, pa.list_(pa.string()))], [id_col, "chunks"])

    least = min(MOST, EVEN_MOST)
    stripped = F.filter(F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: tx.strip(tx.or_empty(p))), lambda p: p != "")
    parts = F.transform(
        stripped, lambda p: F.struct(p.alias("text"), F.when(F.length(p) > least, tx.sentences(p, 1)).otherwise(F.array().cast("array<string>")).alias("sentences"))
    )
    id_type = df.schema[id_col].dataType.simpleString()
    cutted = df.select(id_col, parts.alias("parts")).mapInArrow(run, f"`{id_col}` {id_type}, chunks array<string>")
    return cutted.select(id_col, F.posexplode("chunks").alias("chunk_index", "chunk"))


def pack_chunks(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of about 1000 characters, at most 1200 unless one sentence is longer."""
    return _chunks(df, packed, id_col)


def even_chunks(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of 300 to 1250 characters, about 600; a text's whole length."""
    return _chunks(df, even, id_col)

"""Language identification by cross-parsing entropy.

A suffix automaton of a sample of each language's labelled text gives, from any place of a text, the longest piece that
the sample holds. A text is parsed from left to right into such phrases; the fewer it takes, the nearer it is to the
language. A phrase costs the logarithm of the sample's length, so the normalised number of phrases is an
estimate of the text's cross entropy under the language, and the least one wins.

Symbols are UTF-8 bytes with A-Z lower-cased and other ASCII characters than letters as blanks. Texts are parsed in segments of
SEGMENT bytes, side by side: a phrase ends where its segment does, for each language alike. Whole texts are parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import ship_package, text_of, tidied

#: What is learned from: at most FIT_ROWS labelled rows a language, drawn by hash, EXCERPT characters of each, and at most
#: FIT_LANGUAGES languages, those with most rows. The driver and each worker hold that many samples at most.
FIT_ROWS, EXCERPT, FIT_LANGUAGES = 256, 256, 64
#: Bytes of a segment, and of the segments that are parsed side by side.
SEGMENT, LANES = 512, 8192
UNKNOWN = "und"

#: A letter of any script.
LETTER = re.compile(r"[^\W\d_]")
_SYMBOLS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id):
    """Whether a row is kept from learning: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> dict[str, bytes]:
    """A sample of each language's text, from labelled rows outside the held-out quarter.

    Languages are counted first; a row is drawn if the hash of its text falls below its language's share, so tasks
    return about ``rows`` rows a language and no group is gathered. Equal texts are drawn alike and kept once; texts without
    letters and null labels teach nothing, nor do texts that another language's sample fits better. Without labelled rows
    the sample is empty.
    """
    taught = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & text_of(text_col).rlike(r"\p{L}"))
    labelled = taught.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_LANGUAGES).collect()
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, rows / n))]), F.col("lang"))
    draw = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = labelled.where(draw < share).select("lang", draw.alias("draw"), F.substring("text", 1, EXCERPT).alias("text")).distinct()
    found: dict[str, list[tuple[float, str]]] = {lang: [] for lang, _ in counts}
    for lang, at, text in drawn.orderBy("draw", "text").limit(4 * rows * len(counts)).collect():  # about rows a language
        found[lang].append((at, text))
    samples = {lang: [symbols_of(text) for _, text in sorted(texts)[:rows]] for lang, texts in found.items() if texts}
    return {lang: b"".join(texts) for lang, texts in agreeing(samples).items()}


def agreeing(samples: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """``samples`` without the texts that another language parses better: wrong labels would teach whole texts of another language.

    Each half is judged by what the other half teaches; a language keeps all its texts if it would lose half of them.
    """
    langs = sorted(samples)
    if min(map(len, samples.values())) < 2:
        return samples
    kept: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for half in (0, 1):
        other = {lang: b"".join(samples[lang][1 - half :: 2]) for lang in langs}
        for at, lang in enumerate(langs):
            own = samples[lang][half::2]
            kept[lang] += [text for text, best in zip(own, code_lengths(own, other).argmin(axis=1), strict=True) if best == at]
    return {lang: kept[lang] if 2 * len(kept[lang]) > len(texts) else texts for lang, texts in samples.items()}


def symbols_of(text: str) -> bytes:
    """The symbols of a text: one blank between words, one at either end."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_SYMBOLS).split()) + b" "


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``sample``, by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sample:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


class Parser:
    """Phrases of many segments at once under one sample, by a table of its automaton's transitions."""

    def __init__(self, sample: bytes):
        self.bits = float(np.log2(len(sample) + 1))
        known = sorted(set(sample))
        self.code = np.zeros(256, np.int32)  # 0: a symbol that the sample lacks
        self.code[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        moves = suffix_automaton(sample)
        dead = len(moves)  # after a symbol that the sample lacks, which is a phrase alone
        table = np.full((dead + 1, self.width), -1, np.int64)
        for state, edges in enumerate(moves):
            for symbol, target in edges.items():
                table[state, self.code[symbol]] = target
        root = table[0].copy()
        root[0] = dead
        missing = table < 0
        table = np.where(missing, root[None, :], table) * self.width
        # a move that is not there ends the phrase and begins the next one with its symbol: stored as its complement
        self.table = np.where(missing, ~table, table).astype(np.int32).ravel()

    def phrases(self, lanes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each lane: ``lanes`` holds symbols by place and lane, longest lanes first; ``active`` lanes reach each place."""
        codes = self.code[lanes]
        counts = np.ones(lanes.shape[1], np.int32) - (codes[0] == 0)  # the last phrase; none ends at a first symbol
        states = np.zeros(lanes.shape[1], np.intp)
        for place in range(lanes.shape[0]):
            n = active[place]
            moved = self.table.take(states[:n] + codes[place, :n])
            ended = moved >> 31  # -1 where a phrase ended
            counts[:n] -= ended
            states[:n] = moved ^ ended
        return counts


@lru_cache(maxsize=2 * FIT_LANGUAGES)
def parser(sample: bytes) -> Parser:
    """A worker builds the table of a sample once."""
    return Parser(sample)


def code_lengths(texts: list[bytes], samples: dict[str, bytes]) -> np.ndarray:
    """Bits of each text under each sample: its phrases times the logarithm of the sample's length."""
    pieces = [(n, text[at : at + SEGMENT]) for n, text in enumerate(texts) for at in range(0, len(text), SEGMENT)]
    out = np.zeros((len(texts), len(samples)))
    for first in range(0, len(pieces), LANES):
        part = sorted(pieces[first : first + LANES], key=lambda p: -len(p[1]))
        sizes = np.array([len(p) for _, p in part])
        lanes = np.zeros((len(part), sizes[0]), np.uint8)
        lanes[np.arange(sizes[0])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(p for _, p in part), np.uint8)
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        owners, lanes = np.array([n for n, _ in part]), np.ascontiguousarray(lanes.T)
        for at, sample in enumerate(samples.values()):
            made = parser(sample)
            np.add.at(out[:, at], owners, made.phrases(lanes, active) * made.bits)
    return out


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, bits_per_byte for every whole text.

    The score is the winner's share if languages are weighed by 2 to the power of minus the bits a text takes, divided by the
    root of its length: it falls towards an even share as languages come near each other. Null texts, texts without
    a letter and everything where nothing was learned are ``und`` with score 0. Equal bits go to the language that sorts
    first. Repeated rows are judged alike, a null id is not held out, other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(dict(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = list(known)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, held, column = (c.slice(start, 512) for c in batch.columns)
                texts = [x or "" for x in column.to_pylist()]
                clear = np.array([bool(names) and LETTER.search(x) is not None for x in texts])
                asked = [symbols_of(x) for x, yes in zip(texts, clear, strict=True) if yes]
                picks, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if asked:
                    bits = code_lengths(asked, known)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(asked)), best]
                    sizes = np.array([len(x) for x in asked])
                    places = np.flatnonzero(clear)
                    for place, at in zip(places, best, strict=True):
                        picks[place] = names[at]
                    scores[places] = 1.0 / np.exp2(-(bits - least[:, None]) / np.sqrt(sizes)[:, None]).sum(axis=1)
                    rates[places] = least / sizes
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(picks, pa.string()), pa.array(scores), pa.array(rates)], [id_col, "held_out", "lang_pred", "score", "bits_per_byte"])

    given = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    return given.mapInArrow(lambda batches: tidied(run(batches)), f"{id_col} bigint, held_out boolean, lang_pred string, score double, bits_per_byte double")

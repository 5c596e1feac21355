"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes case, compatibility forms, accents, homoglyphs and digit substitutions, so that disguised
spellings meet the plain ones; both the text and the lexicon are folded. Terms are whole words or word
beginnings with log-odds weights, learned from labelled rows beside a small list of fixed terms. A hit
inside an exception phrase does not count; beside fixed ones, phrases of a hit's word and a neighbour that
speak for clean rows as clearly as terms speak for toxic ones are learned, whatever the language. The weights of
the hits, as a sum and normalised by the length of the text, go through a logistic curve fitted to the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import give_back, ship_package, text_of, tidied

#: Look-alikes of Latin letters in other scripts (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o",
}
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "€": "e"}
#: Terms that are insults without any label, as whole words (fixed values).
SEED_TERMS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "bitch", "whore", "asshole", "dumbass", "retard", "jackass")
#: Phrases in which those words are harmless (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "worthless check", "sore loser rule")

SEED_WEIGHT = 4.0
STEM_LENGTHS = range(4, 8)
#: Labelled rows the model is fitted on at most; above it a hash of the id picks rows of both labels alike.
FIT_ROWS = 40_000
#: Toxic rows that a learned term needs: so many, and this share of all toxic rows.
LEAST_TOXIC, LEAST_SHARE = 3, 0.004
LEAST_ODDS = 12.0
#: And the least product of toxic rows and log-odds.
LEAST_EVIDENCE = 16.0
#: A beginning is no term where one whole word makes up this share of its toxic rows.
ONE_WORD = 0.7

_table = {ord(k): v for k, v in HOMOGLYPHS.items()}
_substitutes = str.maketrans(SUBSTITUTES)
_accents = re.compile("[\u0300-\u036f]+")
_near_digit = re.compile(r"[a-z][0-9@$|€]|[0-9@$|€][a-z]")
_mixed = re.compile(r"[^\W_]*(?:[a-z][0-9@$|€]|[0-9@$|€][a-z])[\w@$|€]*")
_near_dot = re.compile(r"[.\-_*·]\w[.\-_*·]")
_spaced = re.compile(r"(?<!\w)\w(?:([.\-_*·])\w(?:\1\w)+)(?!\w)")
_runs = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_long_run = re.compile(r"([a-z])\1{2,}")
_apart = re.compile(r"[^\w@$|€]+|_+")
_ascii_apart = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) in "@$|")}


def fold(text: str) -> str:
    """Lower case, without accents, homoglyphs, digit substitutions, stretched letters or separators between letters; words apart by one blank."""
    if not text.isascii():
        text = _accents.sub("", unicodedata.normalize("NFKD", text.casefold()))
        if not text.isascii():
            text = text.translate(_table)
    text = text.lower()
    if _near_dot.search(text):
        text = _spaced.sub(lambda m: m[0].replace(m[1], ""), text)
    if _near_digit.search(text):
        text = _mixed.sub(lambda m: m[0].translate(_substitutes), text)
    text = text.translate(_ascii_apart) if text.isascii() else _apart.sub(" ", text)
    if any(run in text for run in _runs):
        text = _long_run.sub(r"\1", text)
    return " ".join(text.split()).replace("l", "i")  # 1 may stand for either


def held_out(doc_id: object) -> bool:
    """Rows that labels are never learned from: crc32 of the id as text, remainder 2 by 4."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


@dataclass
class Lexicon:
    """Folded terms with weights (a trailing blank: whole word), folded exception phrases and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = tuple(fold(p) for p in EXCEPTIONS)
    curve: tuple[float, ...] = (-5.0, 0.5, 0.3, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.weights.items():
                found.add_word(f" {term}", (len(term) + 1, weight))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Where terms begin in a folded text between blanks, outside exception phrases, with the heaviest weight at each place."""
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if not excused or not best:
            return best
        excused.sort()
        kept, at, reach = {}, 0, -1  # phrases that begin at or before the place, and how far they reach
        for place in sorted(best):
            while at < len(excused) and excused[at][0] <= place:
                reach = max(reach, excused[at][1])
                at += 1
            if place >= reach:  # a phrase's last blank may begin a term of its own
                kept[place] = best[place]
        return kept

    def evidence(self, text: str) -> tuple[float, float, int]:
        """The summed weight of the hits (one, the heaviest, for each word), the heaviest of all, and the words of the text."""
        folded = f" {fold(text)} "
        best = self.hits(folded)
        return sum(best.values()), max(best.values(), default=0.0), max(1, folded.count(" ") - 1)

    def features(self, text: str) -> tuple[float, float, float]:
        """The sum; the sum by length, as a logarithm; the heaviest hit."""
        total, most, words = self.evidence(text)
        return total / 10.0, math.log1p(1000.0 * total / words), most

    def phrases(self, text: str) -> set[str]:
        """Each hit's word with the word before it and with the word behind it."""
        folded = f" {fold(text)} "
        found = set()
        for place in self.hits(folded):
            stop = folded.index(" ", place + 1)
            if place:
                found.add(folded[folded.rindex(" ", 0, place) + 1 : stop])
            if stop + 1 < len(folded):
                found.add(folded[place + 1 : folded.index(" ", stop + 1)])
        return found

    def score(self, text: str) -> float:
        level = self.curve[0] + sum(c * f for c, f in zip(self.curve[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, level)))


def term_candidates(text: str) -> set[str]:
    """Distinct whole words (with a trailing blank) and word beginnings of a folded text."""
    found = set()
    for word in set(fold(text).split()):
        found.add(word + " ")
        found.update(word[:n] for n in STEM_LENGTHS if len(word) > n)
    return found


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and term: toxic and clean rows in either half of the rows."""
    for batch in batches:
        halves = [(Counter(), Counter()), (Counter(), Counter())]
        for text, label, half in zip(batch["text"], batch["label"], batch["half"], strict=True):
            halves[half][0 if label else 1].update(term_candidates(text))
        terms = list({t for pair in halves for counts in pair for t in counts})
        columns = {f"{kind}{half}": [halves[half][at][t] for t in terms] for half in (0, 1) for at, kind in enumerate(("toxic", "clean"))}
        yield pd.DataFrame({"term": terms} | columns)
        del terms, columns, halves
    give_back()


def weigh(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Fixed terms, and of (term, toxic rows, clean rows) those whose log-odds rest on enough rows."""
    weights = {fold(t) + " ": SEED_WEIGHT for t in SEED_TERMS}
    if not toxic or not clean:
        return weights
    words = {term: hits for term, hits, _ in counts if term.endswith(" ")}
    single = {}  # of a beginning, the most toxic rows that one whole word has
    for word, hits in words.items():
        for n in STEM_LENGTHS:
            single[word[:n]] = max(hits, single.get(word[:n], 0))
    for term, hits, misses in counts:
        if single.get(term, 0) >= ONE_WORD * hits:
            continue  # the word speaks for itself
        odds = ((hits + 0.25) / (toxic + 0.5)) / ((misses + 0.25) / (clean + 0.5))
        if hits >= max(LEAST_TOXIC, LEAST_SHARE * toxic) and odds >= LEAST_ODDS and hits * np.log(odds) >= LEAST_EVIDENCE:
            weights[term] = float(np.log(odds))
    return weights


def fit_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic coefficients by Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(features)), features))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-4, *[ridge] * (len(w) - 1)])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) / len(x) + penalty @ w / len(x)
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty / len(x) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Lexicon:
    """A lexicon learned from labelled rows outside the held-out quarter.

    At most about ``fit_rows`` labelled ids are used, picked by a hash of the id: that bounds all that is learned, sent to
    the driver or broadcast. An id with several labels counts as toxic if any is; rows that repeat an id teach terms each,
    and the curve once. Rows with a null label or id teach nothing, and without any usable label, or without its document,
    the fixed terms and a fixed curve remain. Terms are counted where the rows are, and counts of a term are summed before they are shuffled.
    """
    ship_package(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("id"), (F.col(label_col).cast("int") > 0).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.crc32(F.col("id").cast("string")) % 4 != 2)
    )
    n = usable.agg(F.count_distinct("id")).first()[0]
    if n > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * fit_rows / n))
    halved = usable.groupBy("id").agg(F.max("label").alias("label")).withColumn("half", (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))).cast("int"))
    # at most about fit_rows short rows, so the texts stay where they are
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(halved), "id")
    totals = {(r["half"], bool(r["label"])): r["n"] for r in halved.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = ([totals.get((half, kind), 0) for half in (0, 1)] for kind in (True, False))
    if not sum(toxic) or not sum(clean):
        return Lexicon(weigh([], 0, 0))
    names = ["toxic0", "clean0", "toxic1", "clean1"]
    texts = rows.select("text", "label", "half")
    counts = texts.mapInPandas(_counted, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    hits, misses = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    odds = ((hits + 0.25) / (sum(toxic) + 0.5)) / ((misses + 0.25) / (sum(clean) + 0.5))
    found = counts.where((hits >= max(LEAST_TOXIC, LEAST_SHARE * sum(toxic))) & (odds >= LEAST_ODDS) & (hits * F.log(odds) >= LEAST_EVIDENCE / 2)).collect()
    weights = weigh([(r["term"], r["toxic0"] + r["toxic1"], r["clean0"] + r["clean1"]) for r in found], sum(toxic), sum(clean))

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Lexicon(weights)
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["label"], strict=True):
                seen[0 if label else 1].update(plain.phrases(text))
            phrases = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"phrase": phrases, "toxic": [seen[0][p] for p in phrases], "clean": [seen[1][p] for p in phrases]})

    phrases = texts.mapInPandas(spoken, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = ((F.col("clean") + 0.25) / (sum(clean) + 0.5)) / ((F.col("toxic") + 0.25) / (sum(toxic) + 0.5))
    learned = phrases.where((F.col("clean") >= LEAST_TOXIC) & (harmless >= LEAST_ODDS) & (F.col("clean") * F.log(harmless) >= LEAST_EVIDENCE)).collect()
    exceptions = tuple(sorted({*Lexicon({}).exceptions, *(r["phrase"] for r in learned)}))
    # the curve is fitted on evidence from terms that were learned on the other half of the rows
    others = [Lexicon(weigh([(r["term"], r[f"toxic{h}"], r[f"clean{h}"]) for r in found], toxic[h], clean[h]), exceptions) for h in (1, 0)]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([others[half].features(t) for t, half in zip(batch["text"], batch["half"], strict=True)], columns=["x", "y", "z"])
            yield frame.assign(label=batch["label"].to_numpy(), id=batch["id"].to_numpy())

    id_type = halved.schema["id"].dataType.simpleString()
    features = rows.mapInPandas(measured, f"x double, y double, z double, label int, id {id_type}")
    seen = features.groupBy("id").agg(F.min(F.struct("x", "y", "z", "label")).alias("row")).select("row.*").toPandas()  # one row for each sampled id
    if seen.empty:  # the labels are of other documents
        return Lexicon(weights, exceptions)
    return Lexicon(weights, exceptions, fit_curve(seen[["x", "y", "z"]].to_numpy(), seen["label"].to_numpy(float)))


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from ``threshold``).

    Null and empty texts score as texts without hits; null ids are kept and hashed as the empty string;
    repeated rows are scored each; an empty table gives no rows; other columns are ignored. A narrow plan:
    the lexicon goes with the task (its size is bounded by the sample it was learned from), texts are scored whole and one at a time.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = [lexicon.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([held_out(i) for i in ids]),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                [id_col, "held_out", "score", "predicted"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(lambda batches: tidied(run(batches)), f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they were; null texts count as empty."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([lexicon.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(lambda batches: tidied(run(batches)), docs.schema)

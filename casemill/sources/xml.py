"""XML scans: judgments with numbered paragraphs, simple documents, whole and tail text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import text as tx

DECISIONS = ("majority", "concurring", "dissenting")
#: Folder names of courts and their codes (fixed values).
COURT_FOLDERS = {"Supreme Court (uksc)": "UKSC", "Tribunal Court (ukut)": "UKUT"}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_NUMBERED = re.compile(r"\n\s*(\d+)\.\s+")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _parse(raw: str) -> ElementTree.Element | None:
    """The root, after replacing control characters if need be; None if it can't be read."""
    for attempt in (raw, _CONTROL.sub(" ", raw)):
        try:
            return ElementTree.fromstring(attempt.encode())
        except ElementTree.ParseError:
            continue
    return None


def _text(element: ElementTree.Element, leave: str = "") -> str:
    parts = [element.text or ""]
    for child in element:
        if _local(child.tag) != leave:
            parts.append(_text(child, leave))
        parts.append(child.tail or "")
    return " ".join(" ".join(parts).split())


def judgment_paragraphs(raw: str, fallback: bool = False) -> list[tuple[str, str]]:
    """(number or "unknown", text) of every paragraph element; with ``fallback`` long p elements where there are none."""
    root = _parse(raw or "")
    if root is None:
        return []
    found = []
    for element in root.iter():
        if _local(element.tag) == "paragraph":
            numbers = [e for e in element if _local(e.tag) == "num"]
            number = _text(numbers[0]) if numbers else ""
            text = _text(element, leave="num")
            if text:
                found.append((number or "unknown", text))
    if not found and fallback:
        found = [("unknown", t) for e in root.iter() if _local(e.tag) == "p" and len(t := _text(e)) > 50]
    return found


def lenient_paragraphs(raw: str) -> list[tuple[str, str]]:
    """Any element whose tag ends in paragraph or p, over 50 characters, nested ones too; else the text split at numbers."""
    root = _parse(raw or "")
    if root is None:
        return []
    found = [("unknown", t) for e in root.iter() if _local(e.tag).lower().endswith(("paragraph", "p")) and len(t := _text(e)) > 50]
    if found:
        return found
    parts = _NUMBERED.split("\n" + "".join(root.itertext()))
    return [(n, " ".join(t.split())) for n, t in zip(parts[1::2], parts[2::2], strict=False) if t.strip()]


def simple_paragraphs(raw: str) -> list[tuple[str, str]]:
    """Paragraphs of document/body/p."""
    root = _parse(raw or "")
    return [] if root is None else [(str(n), t) for n, e in enumerate((e for e in root.iter() if _local(e.tag) == "p"), 1) if (t := _text(e))]


def full_text(raw: str) -> str:
    root = _parse(raw or "")
    return "" if root is None else " ".join(t for s in root.itertext() if (t := " ".join(s.split())))


PARSERS = {"judgment": judgment_paragraphs, "judgment_p": lambda raw: judgment_paragraphs(raw, True), "lenient": lenient_paragraphs, "simple": simple_paragraphs}


def read_files(spark: SparkSession, folder: str | list[str], pattern: str = "*.xml") -> DataFrame:
    """path, doc_id (file stem), folder names as court and decision, content, of the folders' files; sub-folders included.

    ``pattern`` may hold alternatives, as ``*.{html,htm,HTML,HTM}`` does; a file that is reached twice counts twice.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    return files.select(
        path.alias("path"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("doc_id"), F.try_element_at(parts, F.lit(-3)).alias("court_folder"),
        F.try_element_at(parts, F.lit(-2)).alias("decision"), "content",
    )


#: Files of pages, and how many a sample holds (fixed values).
PAGES, SAMPLE = "*.{html,htm,HTML,HTM}", 20


def sampled_files(spark: SparkSession, folder: str | list[str], n: int = SAMPLE, pattern: str = PAGES, seed: int = 0) -> DataFrame:
    """``n`` files of the folders at random, the same ones whenever the files and the seed are; all where there are fewer.

    Files are ordered by a hash of seed and path, and only the chosen ones are opened: the paths are listed without their content first.
    """
    order = F.xxhash64(F.lit(seed), "path")
    chosen = read_files(spark, folder, pattern).select("path").distinct().orderBy(order, "path").limit(n).select("path")
    paths = [r["path"] for r in chosen.collect()]  # n at most
    return read_files(spark, folder, pattern).where(F.col("path").isin(paths)).dropDuplicates(["path"])


def with_court(files: DataFrame) -> DataFrame:
    """Court codes from folder names, unknown ones as UNKNOWN; rows of other decision folders go."""
    court = F.coalesce(*[F.when(F.col("court_folder") == k, v) for k, v in COURT_FOLDERS.items()], F.lit("UNKNOWN"))
    return files.where(F.col("decision").isin(*DECISIONS)).withColumn("court", court)


def paragraphs(files: DataFrame, parser: str = "judgment", least: int = 10) -> DataFrame:
    """doc_id, section_number, sentence_index, text; the index counts short paragraphs too, which are left out."""
    run = PARSERS[parser]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["found"] = [[{"num": n, "text": t} for n, t in run(bytes(c).decode("utf-8", "replace"))] for c in batch["content"]]
            yield batch[["doc_id", "found"]]

    parsed = files.select("doc_id", "content").mapInPandas(apply, "doc_id string, found array<struct<num: string, text: string>>")
    rows = parsed.select("doc_id", F.posexplode("found").alias("sentence_index", "p"))
    return rows.select("doc_id", F.col("p.num").alias("section_number"), "sentence_index", F.col("p.text").alias("text")).where(F.length("text") >= least)


def tail_court(text):
    """The court that the last 1500 characters name."""
    return F.when(F.contains(F.right(text, F.lit(1500)), F.lit("Supreme Court")), "uksc").otherwise("eat")


def to_simple_xml(rows: DataFrame, id_col: str = "doc_id", order: str = "position") -> DataFrame:
    """One document a row: title and paragraphs, escaped."""
    p = F.concat(F.lit("<p>"), tx.escape_markup(F.col("text")), F.lit("</p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), p.alias("p")))), lambda x: x["p"]), "")
    title = tx.escape_markup(F.first(F.col(id_col).cast("string")))
    return rows.groupBy(id_col).agg(F.concat(F.lit("<document><meta><title>"), title, F.lit("</title></meta><body>"), body, F.lit("</body></document>")).alias("xml"))

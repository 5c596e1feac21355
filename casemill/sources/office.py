"""DOCX, RTF and ZIP scans with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_HEX = re.compile(r"\\'([0-9a-fA-F]{2})")
_UNICODE = re.compile(r"\\u(-?\d+)\s?\??")
_GROUPS = re.compile(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts in order; table cells where there is no other paragraph; nothing for a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []

    def text(element: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{_W}t")).strip()

    in_cells = {id(p) for cell in root.iter(f"{_W}tc") for p in cell.iter(f"{_W}p")}
    every = list(root.iter(f"{_W}p"))
    return [t for p in every if id(p) not in in_cells and (t := text(p))] or [t for p in every if (t := text(p))]


def rtf_text(raw: str) -> str:
    """Plain text: paragraph marks as newlines, escapes decoded, control words and braces gone."""
    text = _GROUPS.sub("", raw)
    text = re.sub(r"\\(?:par|line)\b\s?", "\n", text)
    text = _UNICODE.sub(lambda m: chr(int(m[1]) % 65536), text)
    text = _HEX.sub(lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\([\\{}])", lambda m: {"\\": "\x01", "{": "\x02", "}": "\x03"}[m[1]], text)
    text = re.sub(r"\\[a-zA-Z]+-?\d*\s?|\\[^a-zA-Z]|[{}]", "", text)
    return text.translate({1: "\\", 2: "{", 3: "}"}).strip()


def rtf_paragraphs(content: bytes) -> list[str]:
    return [p for block in re.split(r"\n\s*\n", rtf_text(content.decode("latin-1"))) if (p := " ".join(block.split()))]


def rtf_title(content: bytes) -> str:
    raw = content.decode("latin-1")
    named = re.search(r"\\title\s+([^}\\]+)", raw)
    return named[1].strip() if named else next(iter(rtf_text(raw).split("\n")), "").strip()


def zip_members(content: bytes, suffixes: tuple[str, ...]) -> list[dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return [{"name": i.filename, "content": archive.read(i)} for i in archive.infolist() if i.filename.lower().endswith(suffixes)]
    except zipfile.BadZipFile:
        return []


def paragraphs(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, position, text of DOCX or RTF files given as binary rows."""
    run = {"docx": docx_paragraphs, "rtf": rtf_paragraphs}[kind]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["found"] = [run(bytes(c)) for c in batch["content"]]
            yield batch[["doc_id", "found"]]

    found = files.select("doc_id", "content").mapInPandas(apply, "doc_id string, found array<string>")
    return found.select("doc_id", F.posexplode("found").alias("position", "text"))


def sentences(files: DataFrame, kind: str = "docx", least: int = 10) -> DataFrame:
    """doc_id, position, text: the sentences of at least ``least`` characters of each paragraph, without regard to abbreviations."""
    rows = paragraphs(files, kind).select("doc_id", "position", F.posexplode(tx.sentences(F.col("text"), least, protect=False)).alias("at", "text"))
    order = Window.partitionBy("doc_id").orderBy("position", "at")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("position"), "text")


def unzipped(files: DataFrame, suffixes: tuple[str, ...] = (".html", ".htm")) -> DataFrame:
    """path, name, content of the members of archives."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["found"] = [zip_members(bytes(c), suffixes) for c in batch["content"]]
            yield batch[["path", "found"]]

    found = files.select("path", "content").mapInPandas(apply, "path string, found array<struct<name: string, content: binary>>")
    return found.select("path", F.inline("found"))

"""Judgments for files by name: by the address that a file's name holds, else by a search of the feed, each page asked for once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import judgments as jd
from casemill.functions import text as tx
from casemill.operators.answers import answered_once
from casemill.scratch import written
from casemill.session import ship_package
from casemill.sources.feed import best_entry, fetch, open_web

_ATOM = "{http://www.w3.org/2005/Atom}"
#: Kinds of links to a judgment's XML, the better first; entries of a search; characters of a query at least (fixed values).
XML_LINKS, PER_PAGE, LEAST_QUERY = ("application/akn+xml", "application/xml"), 50, 4


def page_of(opener: Callable[[str], tuple[int, bytes]] = open_web, pacing_s: float = 0.6, pause: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """What ``found_cases`` asks: an address in, its text out; slowed down and tried again as the feed's pages are."""

    def ask(url: str) -> str:
        body = fetch(url, opener, pause=pause)
        if pacing_s:
            pause(pacing_s)
        return body.decode("utf-8", "replace")

    return ask


def search_entries(body: str) -> list[tuple[str, str, str, str]]:
    """(id, title, updated, link) of the entries that have a title and a link to XML; none of a page that can't be read."""
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError:
        return []
    found = []
    for entry in root.findall(f"{_ATOM}entry"):
        links = {link.get("type"): link.get("href", "") for link in reversed(entry.findall(f"{_ATOM}link"))}
        href = next((links[kind] for kind in XML_LINKS if links.get(kind)), "")
        row = tuple((entry.findtext(f"{_ATOM}{name}") or "").strip() for name in ("id", "title", "updated")) + (href,)
        if href and row[1]:
            found.append(row)
    return found


def _best(pages: DataFrame) -> DataFrame:
    """query, title, matched, link of the entry that fits each query's page best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, body in zip(batch["query"].to_pylist(), batch["body"].to_pylist(), strict=True):
                entry, matched = best_entry(search_entries(body), query)
                if entry is not None and matched:
                    rows.append({"query": query, "title": entry[1], "matched": matched, "link": entry[3]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("query", pa.string()), ("title", pa.string()), ("matched", pa.int32()), ("link", pa.string())]))

    return pages.select("query", "body").mapInArrow(run, "query string, title string, matched int, link string")


def found_cases(files: DataFrame, endpoint: str, store: str, ask: Callable[[str], str] | None = None) -> DataFrame:
    """name, query, via, title, matched, url, xml, reason: one row for each file, in whatever way its judgment was found.

    ``files`` has name and, if wanted, query and uri, which go before what the name says. A name that holds year and court is an address;
    where there is none, or it gives nothing, the feed is searched with the name's key words (of PDF files only, four characters at least),
    and the entry whose title holds most of them is fetched, the first of equals. ``via`` is uri or search; ``reason``
    tells why there is no XML: no query, no title, or what the server said. Pages are kept in ``store``: distinct addresses are asked for once by many tasks, a
    broken-off run goes on, and those that failed are asked again in the next. Files that repeat a name have one row each.
    """
    ship_package(files.sparkSession)
    ask, base = ask or page_of(), F.lit(endpoint.rstrip("/"))
    given = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    stem = F.when(F.lower("name").endswith(".pdf"), jd.search_query(F.regexp_replace("name", r"\.[^.]*$", "")))
    query = F.coalesce(given("query"), F.when(F.length(stem) >= LEAST_QUERY, stem))
    asked = files.select("name", query.alias("query"), F.coalesce(given("uri"), jd.document_uri(F.col("name"))).alias("uri"))
    # a file that no search could find is left out, whatever address its name holds
    direct = asked.withColumn("direct_url", F.when(F.col("query").isNotNull(), F.concat(base, F.lit("/"), "uri", F.lit("/data.xml"))))
    direct = written(answered_once(direct, "direct_url", ask, store, "direct"), "direct-cases")
    searched = direct.where("direct IS NULL AND query IS NOT NULL").select("query").distinct()
    searched = searched.withColumn("search_url", F.concat(base, F.lit("/atom.xml?query="), F.url_encode("query"), F.lit(f"&per_page={PER_PAGE}")))
    pages = written(answered_once(searched, "search_url", ask, store, "body"), "search-pages")
    best = written(_best(pages.where("body IS NOT NULL")), "best-entries")
    fetched = answered_once(best, "link", ask, store, "found")
    outcome = written(pages.select("query", "body_error").join(fetched, "query", "left"), "found-cases")
    met = direct.join(outcome, "query", "left")
    by_uri = F.col("direct").isNotNull()
    reason = F.when(F.col("query").isNull(), "no query").otherwise(F.coalesce("found_error", "body_error", F.lit("no title")))
    return met.select(
        "name", "query", F.when(by_uri, "uri").when(F.col("found").isNotNull(), "search").alias("via"), F.when(~by_uri, F.col("title")).alias("title"), F.when(~by_uri, F.col("matched")).alias("matched"),
        F.when(by_uri, F.col("direct_url")).otherwise(F.col("link")).alias("url"), F.coalesce("direct", "found").alias("xml"),
        F.when(F.coalesce("direct", "found").isNull(), reason).alias("reason"),
    )


def file_title(rows: DataFrame) -> DataFrame:
    """``rows`` of ``found_cases`` with ``file``, the stem to save the XML under: the entry's title, else the query."""
    bare = F.regexp_replace(F.coalesce("title", "query"), r"(?U)[^\w \-]", "")
    stem = F.substring(F.regexp_replace(tx.strip(bare), r"(?U)\s+", " "), 1, 120)
    return rows.withColumn("file", F.when(F.col("xml").isNotNull(), F.coalesce(F.nullif(stem, F.lit("")), F.lit("document"))))

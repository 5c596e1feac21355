"""A paginated Atom feed as a data source: pages are followed until enough entries are found."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

_ATOM = "{http://www.w3.org/2005/Atom}"


def fetch(url: str, opener: Callable[[str], tuple[int, bytes]], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> bytes:
    """One page: waits a minute when told to slow down, tries again after server errors."""
    for attempt in range(attempts):
        status, body = opener(url)
        if status == 200:
            return body
        if status == 429:
            pause(60)
        elif status >= 500 and attempt < attempts - 1:
            pause(30)
        else:
            break
    raise OSError(f"{url}: status {status}")


def open_local(url: str) -> tuple[int, bytes]:
    path = Path(unquote(urlparse(url).path))
    return (200, path.read_bytes()) if path.is_file() else (404, b"")


def open_web(url: str) -> tuple[int, bytes]:
    """A page over the network: its status and body, errors of the server included."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as answer:  # noqa: S310  the feed's own address
            return answer.status, answer.read()
    except HTTPError as error:
        return error.code, b""


def best_entry(found: list[tuple[str, str, str, str]], query: str) -> tuple[tuple[str, str, str, str] | None, int]:
    """The entry whose title holds most words of the query, the first of equals, and how many; none if no title holds any."""
    words = [w for w in re.split(r"\W+", query.lower()) if len(w) > 1]
    if not found or not words:
        return (found[0] if found else None), 0
    counts = [sum(w in entry[1].lower() for w in words) for entry in found]
    most = max(counts)
    return (found[counts.index(most)], most) if most else (None, 0)


def entries(url: str, most: int, opener: Callable[[str], tuple[int, bytes]] = open_local, pacing_s: float = 0.0) -> Iterator[tuple[str, str, str, str]]:
    """(id, title, updated, link) from the first page on, following rel=next."""
    seen = 0
    while url and seen < most:
        found, url = parsed_page(fetch(url, opener))
        yield from found[: most - seen]
        seen += len(found)
        if pacing_s:
            time.sleep(pacing_s)


def parsed_page(body: bytes) -> tuple[list[tuple[str, str, str, str]], str]:
    """The entries (id, title, updated, link) of a page and the address of the next one, empty on the last."""
    root = ElementTree.fromstring(body)
    found = []
    for entry in root.iter(f"{_ATOM}entry"):
        link = next((e.get("href", "") for e in entry.iter(f"{_ATOM}link")), "")
        found.append(tuple((entry.findtext(f"{_ATOM}{name}") or "").strip() for name in ("id", "title", "updated")) + (link,))
    return found, next((e.get("href", "") for e in root.findall(f"{_ATOM}link") if e.get("rel") == "next"), "")


#: Ids that a feed's place remembers besides those of its last batch: entries move to later pages as new ones appear.
REMEMBERED = 500


class FeedStream(SimpleDataSourceStreamReader):
    """A feed in batches of a few pages; its place is the page to read next and the ids that came last.

    A batch ends early when the feed asks to slow down, and the next one goes on with the page that was refused. At the last page it
    waits for entries or pages to come. A batch that is read again gives the same entries: those that its end remembers.
    """

    def __init__(self, options: dict, opener: Callable[[str], tuple[int, bytes]] | None = None, pause: Callable[[float], None] = time.sleep):
        self.first = options["path"]
        self.pages = max(1, int(options.get("pagespertrigger", options.get("pagesPerTrigger", 10))))
        local = options.get("opener", "local") == "local"
        self.open = opener or (open_local if local else open_web)
        self.pacing_s = 0.0 if local else float(options.get("pacingseconds", options.get("pacingSeconds", 0.5)))
        self.pause = pause

    def initialOffset(self) -> dict:
        return {"next": self.first, "read": 0, "seen": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        url, read, seen, rows = start["next"], start["read"], list(start["seen"]), []
        for _ in range(self.pages):
            status, body = self.open(url)
            if status == 429:
                break
            found, following = parsed_page(body if status == 200 else fetch(url, self.open, pause=self.pause))
            known = set(seen)
            fresh = [row for row in dict.fromkeys(found) if row[0] not in known]
            rows += fresh
            seen += [row[0] for row in fresh]
            if fresh or following:
                read += 1
            if not following:
                break
            url = following
            if self.pacing_s:
                self.pause(self.pacing_s)
        return iter(rows), {"next": url, "read": read, "seen": seen[-max(REMEMBERED, len(rows)) :]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted, url, known, rows = set(end["seen"]), start["next"], set(start["seen"]), []
        for _ in range(max(1, end["read"] - start["read"])):
            found, following = parsed_page(fetch(url, self.open, pause=self.pause))
            for row in found:
                if row[0] in wanted and row[0] not in known:
                    known.add(row[0])
                    rows.append(row)
            if not following:
                break
            url = following
        return iter(rows)


class _Feed(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options["path"].split(",") if u]
        self.most = int(options.get("maxEntries", 2000))
        self.pacing_s = float(options.get("pacingSeconds", 0.5))
        self.local = options.get("opener", "local") == "local"

    def partitions(self) -> list[_Feed]:
        return [_Feed(url) for url in self.urls]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        yield from entries(partition.url, self.most, open_local if self.local else open_web, 0.0 if self.local else self.pacing_s)


class AtomSource(DataSource):
    """``spark.read.format("casemill_atom").load("file:///feed.xml,...")``: a partition for each feed, pages in turn.

    Options: maxEntries, opener (local or web) and pacingSeconds, the wait between pages of the web. As a stream
    (``spark.readStream``) it reads one feed in batches of pagesPerTrigger pages and goes on from its checkpoint.
    """

    @classmethod
    def name(cls) -> str:
        return "casemill_atom"

    def schema(self) -> str:
        return "id string, title string, updated string, link string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AtomSource)

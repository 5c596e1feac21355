"""Judgments on a publisher's pages: metadata, headnotes, sections and the majority opinion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Ids and classes on the publisher's pages, and what ends a title (fixed values).
CONTENT, DOC_ID, CASE_NAME, MAJORITY = "content_document", "doc_id", "hidden_case_name", "contentMajOp"
HEADNOTES, HEADNOTE, NOTE_TEXT, NOTE_TOGGLE, NOTE_TOGGLED = "headnotesContainer", "headnote", "headnote_text", "headnoteToggle", "headnoteText"
NOTE_NAMES = ("headnoteSlug", "headnoteDescriptor")
SECTION, CITES, CITE, CRUMBS, CRUMB = "organization", "citation-group", "cite", "breadCrumbTitleRow", "title"
TITLE_END = ", Court Opinion"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A date in long form (fixed value).
DATE = re.compile(r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}")
SCHEMA = (
    "doc_id string, case_name string, court string, date string, citations array<string>, headnotes array<struct<slug: string, text: string>>, "
    "sections array<struct<title: string, text: string>>, majority_opinion string"
)


class Node:
    """An element with its attributes, children and texts in order."""

    def __init__(self, name: str, given: dict[str, str], parent: Node | None):
        self.name, self.given, self.parent, self.parts = name, given, parent, []

    def classes(self) -> set[str]:
        return set(self.given.get("class", "").split())

    def below(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self, between: str = "\n") -> str:
        found, waiting = [], [self]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                found.append(part)
            else:
                waiting += reversed(part.parts)
        return " ".join(between.join(found).split())

    def first(self, *, name: str | None = None, id_: str | None = None, cls: str | None = None) -> Node | None:
        return next(self.every(name=name, id_=id_, cls=cls), None)

    def every(self, *, name: str | None = None, id_: str | None = None, cls: str | None = None) -> Iterator[Node]:
        for node in self.below():
            if node is not self and name in (None, node.name) and id_ in (None, node.given.get("id")) and (cls is None or cls in node.classes()):
                yield node


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.name not in ("script", "style"):
            self.at.parts.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _value(node: Node | None) -> str | None:
    return node.given.get("value") if node is not None else None


def _headnotes(content: Node) -> list[dict[str, str]]:
    box = content.first(cls=HEADNOTES)
    if box is None:
        return []
    found = []
    for note in box.every(cls=HEADNOTE):
        name = next((t for c in NOTE_NAMES if (n := note.first(cls=c)) and (t := n.text())), "")
        body = note.first(cls=NOTE_TEXT) or next((n for t in note.every(cls=NOTE_TOGGLE) if (n := t.first(cls=NOTE_TOGGLED))), None)
        found.append({"slug": name, "text": body.text() if body else ""})
    found = found or [{"slug": "", "text": n.text()} for n in box.every(cls=NOTE_TEXT)]
    return [n for n in found if n["slug"] or n["text"]]


def _sections(content: Node) -> list[dict[str, str]]:
    heads = [n for n in content.every(name="h1") if SECTION in n.classes()]
    if not heads:
        return [{"title": "Opinion", "text": content.text()}]
    found = []
    for head in heads:
        siblings = head.parent.parts[head.parent.parts.index(head) + 1 :]
        texts = []
        for node in siblings:
            if isinstance(node, Node):
                if node in heads:
                    break
                texts.append(node.text())
        body = " ".join(" ".join(texts).split())
        if body:
            found.append({"title": head.text(" "), "text": body})
    return found


def parse_case(html: str) -> dict:
    """One page's record; what a page lacks is null or empty, and a page without a content element is read whole."""
    root = tree(html)
    content = root.first(id_=CONTENT)
    named = _value(root.first(name="input", id_=CASE_NAME))
    if not named:
        crumb = next((n for row in root.every(cls=CRUMBS) if (n := row.first(cls=CRUMB))), None) or root.first(name="title")
        named = crumb.text(" ").split(TITLE_END)[0].strip() if crumb else None
    court = date = None
    for line in [n.text(" ") for n in (content.every(name="center") if content else ())][:6]:
        court = court or (line if "U.S." in line or "Court" in line else None)
        date = date or next((m[0] for m in [DATE.search(line)] if m), None)
    cites = {n.text(" ") for group in root.every(cls=CITES) for n in group.every(cls=CITE)}
    body = content or root.first(name="body") or root
    majority = body.first(id_=MAJORITY)
    return {
        "doc_id": _value(root.first(id_=DOC_ID)), "case_name": named, "court": court, "date": date, "citations": sorted(c for c in cites if c),
        "headnotes": _headnotes(body), "sections": _sections(body), "majority_opinion": (majority.text() or None) if majority else None,
    }


def publisher_cases(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Each page's id and record; null pages are empty."""
    names = [c.split()[0] for c in ("doc_id", "case_name", "court", "date", "citations", "headnotes", "sections", "majority_opinion")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([parse_case(h) for h in batch[html_col]], columns=names)
            found.insert(0, id_col, batch[id_col].to_numpy())
            yield found

    return pages.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, {SCHEMA}")

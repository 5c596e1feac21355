"""HTML scans: structured page text, classified and extracted paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as tx

_SKIPPED = {"script", "style", "nav", "footer", "noscript"}
#: Elements that an enclosing element's end closes.
_LISTS = {"ul": ("li", "p"), "ol": ("li", "p"), "table": ("td", "tr", "p")}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Collector(HTMLParser):
    """Texts of headings, paragraphs, list items and table rows; blocks of skipped elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {k: [] for k in (*_HEADINGS, "p", "li", "tr", "blockquote", "div", "td")}
        self.open: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif not self.skip and tag in self.found:
            if tag in ("p", "li", "tr") and any(name == tag for name, _ in self.open):
                self.handle_endtag(tag)  # an unclosed one ends here
            self.open.append((tag, []))
        if tag == "td" and not self.skip:
            for name, parts in self.open:
                if name == "tr" and parts:
                    parts.append(" | ")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in _LISTS:
            while self.open and self.open[-1][0] in _LISTS[tag]:
                self.handle_endtag(self.open[-1][0])
        elif any(name == tag for name, _ in self.open):
            while self.open:
                name, parts = self.open.pop()
                text = " ".join("".join(parts).split())
                if text:
                    self.found[name].append(text)
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1][0])


def page_blocks(html: str) -> dict[str, list[str]]:
    collector = _Collector()
    collector.feed(html or "")
    collector.finish()
    return collector.found


def structured(html: str) -> str:
    """All headings by level, then paragraphs, then list items, then table rows."""
    found = page_blocks(html)
    lines = [h for level in _HEADINGS for h in found[level]] + found["p"] + [f"- {x}" for x in found["li"]] + found["tr"]
    return "\n".join(lines)


def case_law_blocks(html: str, least: int = 15, enough: int = 5, enough_chars: int = 3000) -> list[str]:
    """Paragraphs and quotations; if they are few or short, cells and divisions of at least 50 characters too."""
    found = page_blocks(html)
    blocks = [b for b in found["p"] + found["blockquote"] if len(b) >= least]
    if len(blocks) < enough or sum(map(len, blocks)) < enough_chars:
        blocks = [b for kind in ("p", "blockquote", "div", "td") for b in found[kind] if len(b) >= 50]
    return blocks


def _per_page(pages: DataFrame, id_col: str, html_col: str, run, kind: str) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["out"] = [run(h) for h in batch[html_col]]
            yield batch[[id_col, "out"]]

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(apply, f"`{id_col}` {id_type}, out {kind}")


def structured_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    found = _per_page(pages, id_col, html_col, structured, "string")
    return found.select(id_col, F.col("out").alias("text"), F.length("out").cast("long").alias("n_chars"))


def case_law_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of case-law pages without navigation, split at paragraph numbers where that gives 5 to 600."""
    blocks = _per_page(pages, id_col, html_col, case_law_blocks, "array<string>")
    kept = F.filter("out", lambda b: ~tx.is_navigation(b))
    numbered = tx.legal_paragraphs(F.concat(F.lit(" "), F.array_join(kept, " ")))
    usable = (F.size(numbered) >= 5) & (F.size(numbered) <= 600) | (F.size(kept) <= 5)
    return blocks.select(id_col, F.posexplode(F.when(usable, numbered).otherwise(F.slice(kept, 1, 600))).alias("position", "text"))


def classified_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", default: str | None = None, titled: bool = False) -> DataFrame:
    """(text, role) of classified pages: the role is named by the paragraph's class; without one the row goes, or takes ``default``.

    ``titled`` gives the class itself with capitals ("Doctrine And Policy"), as a page that is read back has it, known or not.
    """
    p = F.explode(F.regexp_extract_all(html_col, F.lit(r"(?s)(<p\b[^>]*>.*?</p>)"), 1)).alias("p")
    rows = pages.select(id_col, p)
    slug = F.regexp_extract("p", r"class=[\"']([^\"'\s]+)", 1)
    named = F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))) if titled else tx.canonical_role(slug)
    role = F.coalesce(F.when(slug != "", named), F.lit(default) if default else F.lit(None))
    return rows.select(id_col, tx.collapse(F.regexp_replace("p", "<[^>]+>", "")).alias("text"), role.alias("role")).where("role IS NOT NULL")


#: Tags before which an open paragraph ends, besides its own end tag.
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)
OPENS, ENDS = r"(?i)<p(?:\s[^>]*)?>", rf"(?is)</?(?:{'|'.join(ENDS_PARAGRAPH)})(?:[\s/>].*)?$"


def extracted_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 10) -> DataFrame:
    """id, position, text of every paragraph of at least ``least`` characters, with or without an end tag.

    A paragraph runs from its tag to its end tag or to the next tag that can't stand in one; tags inside it are blanks.
    Positions count the page's paragraph tags from 0. Null and empty pages have none.
    """
    pieces = F.split(html_col, OPENS)
    p = F.posexplode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("position", "p")
    rows = pages.where(F.col(html_col).isNotNull()).select(id_col, p)
    return rows.select(id_col, "position", tx.collapse(tx.strip_tags(F.regexp_replace("p", ENDS, ""))).alias("text")).where(F.length("text") >= least)


def classified_html(rows: DataFrame, id_col: str = "doc_id", order: str = "position") -> DataFrame:
    """One page a document: a heading and a paragraph for each row, its class the role's slug; texts are escaped."""
    line = F.concat(F.lit('<p class="'), tx.role_slug(F.col("role")), F.lit('">'), tx.escape_markup(F.col("text")), F.lit("</p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(id_col).agg(F.concat(F.lit("<h1>"), F.first(F.col(id_col).cast("string")), F.lit("</h1>\n"), body).alias("html"))

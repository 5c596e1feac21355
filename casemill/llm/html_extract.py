"""Main text of web pages by maximum-scoring subsequences of words and tags.

A page is read once into a sequence of tags and text runs. A word scores by what stands around it: the elements
that are open, their class, id and role names, and whether it is link text. These are features of a logistic
regression fitted to labelled pages, and the score is the log-odds of standing in the labelled content; a tag
always costs, and more where tags are seldom in content. One linear scan finds all maximal subsequences
(Ruzzo and Tompa); the best one is the content region, with those that stand in the same article or score
a good part of it (content that a list of links, say, cuts in two). Where the region stands in an article element, what
lies outside it is not its text, whatever it is called and in whatever language: remarks and notices behind the article, articles
inside it (readers' comments, by the HTML standard), and other articles that score little beside it. Words of the regions that score
above zero are the text, joined block by block. Only what HTML never shows is left out without a score.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import ship_package, text_of

#: Elements whose content is never text of the page (fixed values of the HTML standard).
RAW = frozenset("script style noscript template iframe object svg canvas audio video head title textarea select option button".split())
#: Elements whose content the parser must not read as markup (fixed values of the HTML standard).
OPAQUE = frozenset("script style textarea title noscript iframe template".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a block (fixed values of the HTML standard's rendering).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind is closed by a start of one of the second (fixed values of the HTML standard).
IMPLIED = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements that say nothing of their own about what stands in them.
NEUTRAL = frozenset("html body div span b i em strong u small font section center tbody thead tr br".split())
#: First words of class names that describe a state or the page's layout, not the element's content.
MODIFIERS = frozenset("with has no is without not overflow layout page js wp col row".split())

_tag = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?][^>]*)(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_hidden_style = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_opaque_end = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in OPAQUE}

LABEL_OPEN, LABEL_CLOSE = "content", "/content"
#: Bounds of a word's score: one run of strange words can't outweigh an article.
LOWEST, HIGHEST = -4.0, 2.0
#: Regions with this share of the best one's score are content too.
REGION_SHARE = 0.2


@dataclass(slots=True)
class Run:
    """A tag (words 0) or a text run of a page: score of a word or of the tag, words, text, block, the innermost article or main element it stands in (0: none), label, features, the one around that, and whether it stands in an h1."""

    score: float
    words: int
    text: str
    block: int
    main: int
    inside: bool
    features: tuple[str, ...] = ()
    around: int = 0
    title: bool = False


@dataclass(frozen=True)
class Weights:
    """The regression's weight of each feature, its constant, and the cost of each tag."""

    of: Mapping[str, float] = field(default_factory=dict)
    constant: float = 1.0
    tags: Mapping[str, float] = field(default_factory=dict)
    tag: float = -0.5


def attributes(rest: str) -> dict[str, str]:
    """An element's attributes by lower-case name, the first of equals."""
    found: dict[str, str] = {}
    for name, *values in _attribute.findall(rest):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _features(name: str, given: Mapping[str, str], in_main: bool) -> set[str]:
    """What an element says about the words in it: its name, and the first and last word of its class, id and role names."""
    found = set() if name in NEUTRAL else {f"{'inner' if in_main else 'page'}:{name}"}
    for key in ("class", "id", "role"):
        if key in given and not (key == "id" and name in HEADINGS):  # a heading's id is an anchor
            for value in given[key].split():
                parts = [p.lower() for p in _name_parts.findall(value)]
                if parts and parts[0] not in MODIFIERS:
                    found |= {f"name:{parts[0]}", f"name:{parts[-1]}"}
    return found


def _is_hidden(given: Mapping[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden") == "true" or bool(_hidden_style.search(given.get("style", "")))


def runs(html: str, weights: Weights = Weights(), labelled: bool = False) -> list[Run]:
    """The page as tags and text runs, in one pass; broken and unclosed markup is read as browsers do, roughly.

    ``labelled`` keeps each run's features, for fitting.
    """
    found: list[Run] = []
    stack: list[tuple[str, bool, int, tuple[str, ...]]] = []  # name, unseen, the main before it, features
    around = [0]  # of each main the one it stands in
    open_at: dict[str, list[int]] = defaultdict(list)  # the depths at which a name is open
    blocks_at: list[int] = []  # the depths of open blocks
    active: dict[str, int] = defaultdict(int)
    level = weights.constant
    unseen = block = mains = main = 0
    inside, at, size = False, 0, len(html)

    def push(name: str, rest: str) -> None:
        nonlocal level, unseen, main, mains
        given = attributes(rest) if rest and not rest.isspace() else {}
        hidden = name in RAW or (bool(given) and _is_hidden(given))
        features = tuple(_features(name, given, main > 0)) if not unseen else ()
        for feature in features:
            active[feature] += 1
            if active[feature] == 1:
                level += weights.of.get(feature, 0.0)
        open_at[name].append(len(stack))
        if name in BLOCKS:
            blocks_at.append(len(stack))
        stack.append((name, hidden, main, features))
        unseen += hidden
        if name in MAIN and (name == "article" or not main):
            mains += 1
            around.append(main)
            main = mains

    def pop_to(depth: int) -> None:
        nonlocal level, unseen, main
        while len(stack) > depth:
            name, hidden, main, features = stack.pop()  # main: back to what was around
            open_at[name].pop()
            if name in BLOCKS:
                blocks_at.pop()
            unseen -= hidden
            for feature in features:
                active[feature] -= 1
                if not active[feature]:
                    del active[feature]
                    level -= weights.of.get(feature, 0.0)

    def add(score: float, words: int, text: str) -> None:
        found.append(Run(score, words, text, block, main, inside, tuple(active) if labelled else (), around[main], bool(open_at["h1"])))

    def add_text(raw: str) -> None:
        if not unseen and raw:
            text = unescape(raw) if "&" in raw else raw
            words = len(text.split())
            add(min(HIGHEST, max(LOWEST, level)) if words else 0.0, words, text)

    while at < size:
        start = html.find("<", at)
        if start < 0:
            add_text(html[at:])
            break
        match = _tag.match(html, start)
        if match is None:  # a lone "<" is text
            following = html.find("<", start + 1)
            following = size if following < 0 else following
            add_text(html[at:following])
            at = following
            continue
        add_text(html[at:start])
        at = match.end()
        if match["comment"] is not None:
            label = match["comment"].strip()
            inside = label == LABEL_OPEN or (inside and label != LABEL_CLOSE)
            continue
        if match["name"] is None:
            continue
        name = match["name"].lower()
        is_block = name in BLOCKS
        if is_block:
            block += 1
        if not unseen:
            kind = f"tag:{'inner' if main else 'page'}:{name if is_block or name == 'a' else 'inline'}"
            add(weights.tags.get(kind, weights.tag), 0, " " if name == "br" else "")
            if labelled:
                found[-1].features = (kind,)
        if match["close"]:
            depth = open_at[name][-1] if open_at[name] else -1
            if depth >= 0 and (is_block or not blocks_at or depth > blocks_at[-1]):  # else a stray end tag
                pop_to(depth)
            continue
        if is_block and blocks_at and name in IMPLIED.get(stack[blocks_at[-1]][0], ()):
            pop_to(blocks_at[-1])
        if name in VOID or match["rest"].endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in OPAQUE:
            end = _opaque_end[name].search(html, at)
            at = end.end() if end else size
            continue
        push(name, match["rest"])
    return found


def fit_weights(labelled: Sequence[str], rounds: int = 25, ridge: float = 0.02) -> Weights:
    """Weights from pages whose content lies between the comments ``content`` and ``/content``.

    A word's log-odds of standing in the content are fitted by logistic regression (Newton steps, a small ridge) on
    the features of its run, each run counted by its words' square root. A tag costs half a point less a quarter of its
    log-odds, 0.05 at least and two points at most.
    """
    rows: dict[tuple[tuple[str, ...], bool], float] = defaultdict(float)
    seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    for page in labelled:
        for run in runs(page, labelled=True):
            if run.words:
                rows[tuple(sorted(run.features)), run.inside] += run.words**0.5
            elif run.features and run.features[0].startswith("tag:"):
                seen[run.features[0]][run.inside] += 1
    names = sorted({name for features, _ in rows for name in features})
    place = {name: at + 1 for at, name in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for at, (features, _) in enumerate(rows):
        x[at, [place[name] for name in features]] = 1
    y = np.array([inside for _, inside in rows], float)
    count = np.array(list(rows.values()))
    count *= len(count) / count.sum()
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (count * (p - y)) + penalty * w)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    tags = {kind: min(-0.05, max(-2.0, float(np.log(within / outside)) / 4 - 0.5)) for kind, (outside, within) in seen.items()}
    return Weights(dict(zip(names, w[1:].tolist(), strict=True)), float(w[0]), tags)


def maximal_regions(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring subsequences as half-open ranges with their sums, in order, in linear time.

    Every positive score lies in exactly one of them, and the best contiguous range of all is among them.
    """
    open_: list[tuple[int, int, float, float]] = []  # start, stop, sum before it, sum up to its end
    lower: list[int] = []  # for each, the nearest one before it whose sum before is smaller, or -1
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, stop = at, at + 1
        while True:
            nearest = len(open_) - 1
            while nearest >= 0 and open_[nearest][2] >= before:
                nearest = lower[nearest]
            if nearest < 0 or open_[nearest][3] >= total:
                break
            start, before = open_[nearest][0], open_[nearest][2]
            del open_[nearest:], lower[nearest:]
        open_.append((start, stop, before, total))
        lower.append(nearest)
    return [(start, stop, upto - before) for start, stop, before, upto in open_]


def content_regions(page: Sequence[Run]) -> list[tuple[int, int]]:
    """The best region, and those in the same article or with REGION_SHARE of its score."""
    regions = maximal_regions([run.score * max(1, run.words) for run in page])
    if not regions:
        return []
    start, stop, best = max(regions, key=lambda region: (region[2], -region[0]))
    mains = {run.around or run.main for run in page[start:stop] if run.words} - {0}
    return [
        (first, last) for first, last, score in regions
        if score >= REGION_SHARE * best or any((run.around or run.main) in mains for run in page[first:last] if run.words)
    ]


def content_runs(page: Sequence[Run]) -> list[Run]:
    """The runs of the content regions that are text of the page, and the tags among them.

    An article (or a main element) is the text's own if it has the page's title, an h1 inside it or before it in the main element around
    it, and REGION_SHARE of what the regions score, or if it has half of that without one. Others beside it with REGION_SHARE of
    its score are text too, and so is what the main element around it holds before it begins; what comes behind, stands
    outside or is an article inside it is not. Without such an element all of the regions is text.
    """
    kept = [(at, page[at]) for start, stop in content_regions(page) for at in range(start, stop)]
    scores: dict[int, float] = defaultdict(float)
    begins: dict[int, int] = {}
    for at, run in kept:
        if run.score > 0 and run.words:
            scores[run.main] += run.score * run.words
            begins.setdefault(run.main, at)
    parents = {run.main: run.around for _, run in kept}
    titles = [(at, run.main) for at, run in kept if run.title and run.words]
    whole = sum(scores.values())

    def titled(main: int) -> bool:
        return any(scope == main or (scope and scope == parents[main] and at < begins[main]) for at, scope in titles)

    own = [main for main, score in scores.items() if main and (2 * score >= whole or score >= REGION_SHARE * whole and titled(main))]
    if not own:
        return [run for _, run in kept]
    # an article inside a main element is the text if little stands before it there, else what stands before it is
    before = {main: sum(run.score * run.words for at, run in kept if run.score > 0 and run.main == parents[main] and at < begins[main]) for main in own if parents[main]}
    inner = {main for main, score in before.items() if score < scores[main] and titled(main)}
    own = [main for main in own if main in inner or not parents[main]] or own
    best = max(own, key=lambda main: (titled(main), main in inner, scores[main], -main))
    chosen = {main for main, score in scores.items() if main and score >= REGION_SHARE * scores[best]}
    chosen = {main for main in chosen if main == best or not (parents[main] == best or parents[best] == main)}
    return [run for at, run in kept if run.main in chosen or (run.main and run.main == parents[best] and at < begins[best])]


def main_text(html: str, weights: Weights) -> str:
    """The page's main text: blocks in order joined by a newline, white space inside a block made one blank."""
    blocks: dict[int, list[str]] = {}
    for run in content_runs(runs(html, weights)):
        if run.score > 0 or not run.words:
            blocks.setdefault(run.block, []).append(run.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(block for block in joined if block)


# ---- labelled pages, made by rule ---------------------------------------------------------------------------------

#: Wrappers of the content in the usual layouts; {} is the content.
LAYOUTS = (
    "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div id='content'>{}</div>", "<div>{}</div>", "{}",
    "<div class='post'><div class='entry-content'>{}</div></div>", "<section class='story'>{}</section>", "<div class='article-body'>{}</div>",
    "<table><tr><td class='text'>{}</td></tr></table>", "<div class='page with-sidebar'><article>{}</article></div>",
    "<div class='overflow-hidden'><div class='main'>{}</div></div>", "<article class='post hentry'><div class='text'>{}</div></article>",
    "<div class='site-content'><div class='content-area'>{}</div></div>", "<div class='inner'>{}</div>", "<div class='text-box'>{}</div>",
    "<div id='site'><div class='area'><article>{}</article></div></div>", "<div class='box'><p>{}</div>", "<div class='list'><section>{}</section></div>",
)
#: Names of boxes around the content, by what stands in them.
BOXES = {
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs pagination toolbar topbar toc skip pager menubar",
    "prose": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice gdpr popup modal overlay "
    "sidebar widget teaser related recommended newsletter subscribe signup login footer copyright disclaimer masthead header share social complementary contentinfo alert",
    "comments": "comments comment commentlist replies reply respond disqus",
}
WORDS = "time people year way day man thing woman life child world school state family student group country problem hand part place case week company system".split()


def labelled_pages(pages: int = 1000, seed: int = 7) -> list[str]:
    """Pages of the usual layouts with menus, headers, adverts, notices, sidebars, forms, comments and footers around and inside the content."""
    rng = random.Random(seed)
    boxes = {kind: names.split() for kind, names in BOXES.items()}

    def prose(least: int, most: int) -> str:
        words = [rng.choice(WORDS) for _ in range(rng.randint(least, most))]
        if len(words) > 12 and rng.random() < 0.4:
            words[5] = f"<a href='#'>{words[5]}</a>"
        if len(words) > 12 and rng.random() < 0.3:
            words[8] = f"<b>{words[8]}</b>"
        return " ".join(words)

    def links(count: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{n}'>{prose(1, 4)}</a></li>" for n in range(count)) + "</ul>"

    def paragraphs(least: int, most: int) -> str:
        return "".join(f"<p>{prose(8, 60)}</p>" for _ in range(rng.randint(least, most)))

    def named(kind: str, body: str) -> str:
        name, tag = rng.choice(boxes[kind]), rng.choice(["div", "div", "section", "ul" if "<li" in body else "div"])
        name = rng.choice([name, name, f"site-{name}", f"{name}-{rng.choice(['box', 'area', 'list', 'inner'])}"])
        return f"<{tag} {rng.choice(['class', 'class', 'id', 'role'])}='{name}'>{body}</{tag}>"

    def chrome() -> str:
        return rng.choice([
            lambda: f"<nav>{links(6)}</nav>", lambda: links(rng.randint(3, 9)), lambda: named("menu", links(5)), lambda: named("menu", prose(2, 9)),
            lambda: f"<header><h2>{prose(1, 3)}</h2><p>{prose(3, 9)}</p></header>", lambda: f"<aside><h3>{prose(1, 3)}</h3>{paragraphs(1, 3)}</aside>",
            lambda: f"<form><label>{prose(1, 2)}</label><input name='m'><p>{prose(3, 9)}</p></form>", lambda: named("prose", paragraphs(1, 2)),
            lambda: named("prose", prose(3, 20)), lambda: named("comments", "".join(named("comments", paragraphs(1, 2)) for _ in range(rng.randint(1, 4)))),
            lambda: named("comments", f"<article>{paragraphs(1, 2)}</article>"), lambda: f"<dialog>{paragraphs(1, 1)}</dialog>", lambda: f"<menu>{links(3)}</menu>",
        ])()

    def inner() -> str:
        part = rng.choice([
            lambda: f"<h2 id='{rng.choice(WORDS)}'>{prose(2, 5)}</h2>", lambda: f"<blockquote>{prose(9, 30)}</blockquote>", lambda: f"<pre>{prose(3, 20)}</pre>",
            lambda: "<ul>" + "".join(f"<li>{prose(2, 15)}</li>" for _ in range(3)) + "</ul>", lambda: "<ol><li>" + f"{prose(3, 9)}</li><li>{prose(3, 9)}</ol>",
            lambda: f"<table><tr><th>{prose(1, 2)}</th><td>{prose(1, 4)}</td></tr></table>", lambda: f"<figure><figcaption>{prose(3, 9)}</figcaption></figure>",
            lambda: f"<dl><dt>{prose(1, 2)}<dd>{prose(3, 9)}</dl>", lambda: f"<section>{paragraphs(1, 2)}</section>", lambda: f"{prose(9, 30)}<br>{prose(5, 20)}",
            lambda: f"<header><h3>{prose(2, 4)}</h3></header>", lambda: f"<details><summary>{prose(2, 4)}</summary>{prose(5, 9)}</details>",
        ])()
        if rng.random() < 0.35:
            outside = rng.choice([
                lambda: named("prose", prose(3, 20)), lambda: named("prose", paragraphs(1, 2)), lambda: named("prose", f"<h3>{prose(1, 3)}</h3><ul><li>{prose(1, 9)}</ul>"),
                lambda: f"<aside>{paragraphs(1, 2)}</aside>", lambda: f"<form>{prose(2, 6)}<input></form>", lambda: named("menu", f"<h4>{prose(1, 3)}</h4>{links(3)}"),
                lambda: f"<footer>{prose(2, 8)}</footer>", lambda: f"<nav>{links(4)}</nav>", lambda: named("comments", paragraphs(1, 3)),
            ])()
            part += f"<!--/content-->{outside}<!--content-->"
        return part

    made = []
    for _ in range(pages):
        body = f"<h1>{prose(2, 8)}</h1>" if rng.random() < 0.8 else ""
        body += "".join(paragraphs(1, 3) + (inner() if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.15:
            body += f"<h2>{prose(1, 2)}</h2>" + links(4)  # sources
        core = rng.choice(LAYOUTS).format(f"<!--content-->{body}<!--/content-->")
        above, below = ("".join(chrome() for _ in range(rng.randint(0, 3))) for _ in range(2))
        made.append(f"<html><head><title>t</title></head><body>{above}{core}{below}<footer>&copy; {prose(2, 9)}</footer></body></html>")
    return made


@cache
def default_weights() -> Weights:
    """Weights of :func:`labelled_pages`; fitted on the driver and sent with the task."""
    return fit_weights(labelled_pages())


def extract(pages: DataFrame, weights: Weights | None = None, id_cols: Sequence[str] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per page: the id columns, text and n_chars (code points).

    Null and empty pages, and pages without content, give an empty text and 0; null ids are kept; repeated
    rows are read each; an empty table gives no rows; other columns are ignored. A narrow plan, one whole
    page at a time, linear in its length.
    """
    ship_package(pages.sparkSession)
    used = weights or default_weights()
    source = pages.select(*[F.col(c) for c in id_cols], text_of(html_col).alias("__html"))
    kept = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), used) for page in batch.column(kept)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                [*id_cols, "text", "n_chars"],
            )

    ids = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return source.mapInArrow(run, f"{ids}, text string, n_chars long")

import random
import time

import pytest

from casemill.llm.html_extract import Run, content_regions, default_weights, extract, labelled_pages, main_text, maximal_regions, runs

PROSE = "some words that make a sentence of the article here."


def text(body, head=""):
    return main_text(f"<html><head>{head}</head><body>{body}</body></html>", default_weights())


def test_boilerplate_goes_and_the_article_stays():
    page = (
        f"<header><h1>Site</h1></header><nav><ul><li><a href='/'>x</a></li></ul></nav><div class='cookie-notice'>We use {PROSE}</div>"
        f"<article><h1>T &amp; U</h1><p>{PROSE}<p><b>bold\n {PROSE}<br>more</p><div class='ad'>buy {PROSE}</div><script>var t='</p>';</script>"
        f"<form>a<input></form><aside>{PROSE * 9}</aside><ul><li>one<li>two</ul><p>last.</p><section id='comments'><p>troll {PROSE}</p></section></article>"
        f"<div class='sidebar'><p>{PROSE}</p></div><footer>&copy; {PROSE}</footer>"
    )
    assert text(page, "<title>no</title><style>p{}</style>") == f"T & U\n{PROSE}\nbold {PROSE} more\none\ntwo\nlast."


def test_pages_without_article_and_odd_markup():
    assert text(f"<div id='menu'><a href=1>a</a></div><div><h2>T</h2><p>{PROSE}</p><p>x &lt; y&nbsp;z</p></div>") == f"T\n{PROSE}\nx < y z"
    assert main_text("", default_weights()) == "" and main_text("no markup", default_weights()) == "no markup"
    assert main_text("<p>a < b <unclosed attr='", default_weights()).startswith("a < b")
    assert len(runs("<p>" * 30000)) == 30000


@pytest.mark.parametrize("layout", [
    "<div class='overflow-hidden'><article>{}</article></div>",
    "<div class='page with-sidebar'><article>{}</article></div>",
    "<div class='overflow-hidden'><div>{}</div></div>",
    "<article>{}</article>",
    "<main>{}</main>",
])
@pytest.mark.parametrize("part", [
    f"<p title='a hidden gem'>{PROSE}</p>", f"<p data-hidden='false'>{PROSE}</p>", f"<p data-id='menu-3'>{PROSE}</p>", f"<p><a href='/the-hidden-cost'>{PROSE}</a></p>",
    f"<h2 id='legal'>{PROSE}</h2>", f"<section id='discussion'><p>{PROSE}</p></section>", f"<p><math>{PROSE}</math></p>",
])
def test_attributes_and_wrappers_that_only_look_like_boilerplate(layout, part):
    body = f"<h1>Title</h1><p>{PROSE}</p>{part}<p>{PROSE} {PROSE}</p>"
    assert text(f"<nav><a href=1>menu</a></nav>{layout.format(body)}<footer>{PROSE}</footer>") == f"Title\n{PROSE}\n{PROSE}\n{PROSE} {PROSE}"


def test_two_parts_of_the_content_around_a_list_of_links():
    links = "<ul>" + "".join(f"<li><a href='/{n}'>other page {n}</a></li>" for n in range(30)) + "</ul>"
    part = f"<div><p>{PROSE} {PROSE}</p><p>{PROSE}</p></div>"
    assert text(part + links + part) == "\n".join([f"{PROSE} {PROSE}", PROSE] * 2)


def test_the_region_decides_where_no_element_does():
    links = "".join(f"<a href='/{n}'>go {n}</a> " for n in range(40))
    far = "<div>" + "<div><span>stray</span></div>" * 3 + "</div>"
    page = runs(f"<body>{far}{links}<div><p>{PROSE}</p><p>{PROSE}</p></div></body>", default_weights())
    every = [run for run in page if run.words and run.score > 0]
    kept = [run for start, stop in content_regions(page) for run in page[start:stop] if run.words and run.score > 0]
    assert [run.text for run in kept] == [PROSE] * 2 and len(every) > len(kept)


def brute_force(scores):
    """Maximal subsequences by their definition: the best range of all, then the same on either side of it."""
    best = max(((sum(scores[i:j]), -j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    # of ranges with equal sums the shortest that is farthest left
    if best[0] <= 0:
        return []
    options = [(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if sum(scores[i:j]) == best[0]]
    start, stop = min(options, key=lambda o: (o[1] - o[0], o[0]))
    return brute_force(scores[:start]) + [(start, stop, best[0])] + [(i + stop, j + stop, s) for i, j, s in brute_force(scores[stop:])]


def test_regions_are_the_maximal_subsequences():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -1, 1, 2]) + rng.random() * 0.01 for _ in range(rng.randint(0, 14))]
        got = [(i, j) for i, j, _ in maximal_regions(scores)]
        assert got == [(i, j) for i, j, _ in brute_force(scores)]
    best = max(maximal_regions(scores := [1, -2, 3, -1, 2, -9, 3]), key=lambda r: r[2])
    assert best == (2, 5, 4) and scores


def test_best_region_text_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        page = [Run(rng.choice([-2.0, -0.5, 1.0, 2.0]) + rng.random() * 0.01, rng.randint(1, 3), f"t{n}", n, 0, False) for n in range(rng.randint(1, 12))]
        scores = [run.score * run.words for run in page]
        regions = brute_force(scores)
        best = max((s for _, _, s in regions), default=0)
        assert content_regions(page) == [(i, j) for i, j, s in regions if s >= 0.2 * best]


def test_reading_is_linear():
    def seconds(n):
        begun = time.perf_counter()
        for page in ("<span>" * n + "</div>" * n, "<b><div>" + "<span>" * n + "</b>" * n, "<li>" * n + "</ul>" * n, "<p>a" * n):
            runs(page)
        return time.perf_counter() - begun

    seconds(2000)
    assert seconds(32_000) < 40 * seconds(2000) + 0.5  # sixteen times the text


def test_new_labelled_pages_are_recovered():
    weights, words, wrong = default_weights(), 0, 0
    for page in labelled_pages(150, seed=99):
        read = runs(page, weights)
        kept = {at for start, stop in content_regions(read) for at in range(start, stop) if read[at].words and read[at].score > 0}
        for at, run in enumerate(read):
            words += run.words
            wrong += run.words * (run.inside != (at in kept))
    assert wrong < 0.03 * words


def test_operator(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, "u", f"<article><p>{PROSE}</article>", 5), (None, None, None, 5), (1, "u", "", 5), (1, "u", "", 5), (2, "l", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    whole = "\n".join([PROSE] * 20_000)
    expected = [(1, "u", PROSE, len(PROSE)), (None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, "l", whole, len(whole))]
    assert sorted(str(tuple(r)) for r in extract(pages).collect()) == sorted(map(str, expected))
    assert extract(pages.limit(0)).count() == 0


ARTICLE = f"<h1>Titel</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p>"
WANTED = f"Titel\n{PROSE}\n{PROSE} {PROSE}"
REMARKS = "".join(f"<div><b>Anna {n}</b><p>Ganz anderer Meinung, {PROSE}</p></div>" for n in range(4))


@pytest.mark.parametrize("page", [
    f"<article>{ARTICLE}</article><section id='discussion'>{REMARKS}</section>",
    f"<article>{ARTICLE}</article><div class='kommentare'>{REMARKS}</div>",
    f"<div class='cmp-dialog'><p>Wir und unsere Partner, {PROSE}</p><button>Ja</button></div><article>{ARTICLE}</article>",
    f"<main><article>{ARTICLE}</article><section class='opinions-lecteurs'>{REMARKS}</section></main>",
    f"<main><h1>Titel</h1><article><p>{PROSE}</p><p>{PROSE} {PROSE}</p></article><div id='opiniones'>{REMARKS}</div></main>",
    f"<article>{ARTICLE}<div>{''.join(f'<article><p>{r} {PROSE}</p></article>' for r in 'abc')}</div></article>",
    f"<article>{ARTICLE}{ARTICLE.replace('Titel', 'Mehr')}</article>" + "".join(f"<article><p>Teaser {n}</p></article>" for n in range(5)),
    f"<main>{ARTICLE}</main><div class='x9f3'>{REMARKS}</div><div class='q1'><p>Publicité: {PROSE}</p></div>",
    f"<div class='wrapper'><article>{ARTICLE}</article><div class='ugc'>{REMARKS}</div></div>",
])
def test_what_stands_outside_the_article_goes_whatever_its_name(page):
    wanted = f"{WANTED}\n{WANTED.replace('Titel', 'Mehr')}" if "Mehr" in page else WANTED
    assert text(page) == wanted


def test_two_articles_of_a_page_stay():
    assert text(f"<article>{ARTICLE}</article><article>{ARTICLE}</article>") == f"{WANTED}\n{WANTED}"


def test_a_teaser_inside_the_main_element_is_not_the_page():
    body = "".join(f"<p>{n} {PROSE} {PROSE}</p>" for n in range(6))
    page = f"<main><h1>Titel</h1>{body}<article><p>{PROSE}</p><p>{PROSE}</p></article></main>"
    assert text(page) == "\n".join(["Titel", *[f"{n} {PROSE} {PROSE}" for n in range(6)]])

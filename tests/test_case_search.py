import sys
from pathlib import Path

from pyspark import cloudpickle

from casemill.scratch import fresh
from casemill.sources import html, search, xml

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

BASE = "https://cases.example"
ENTRY = '<entry><id>{0}</id><title>{1}</title><updated>x</updated><link href="{0}.html" type="text/html"/>{2}</entry>'


def link(href, kind="application/akn+xml"):
    return f'<link href="{href}" type="{kind}"/>'


def feed(*entries):
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(entries)}</feed>'.encode()


PAGES = {
    f"{BASE}/ukhl/1932/100/data.xml": b"<a>direct</a>",
    f"{BASE}/atom.xml?query=Alpha+Beta&per_page=50": feed(
        ENTRY.format("1", "Alpha v Other", link(f"{BASE}/1.xml")), ENTRY.format("2", "Beta v Alpha", link(f"{BASE}/2b.xml", "application/xml") + link(f"{BASE}/2.xml")),
        ENTRY.format("3", "Alpha v Beta", link(f"{BASE}/3.xml")), ENTRY.format("4", "Alpha Beta Beta", ""),
    ),
    f"{BASE}/2.xml": b"<a>second \xc3\xa9</a>",
    f"{BASE}/atom.xml?query=Gamma+Delta&per_page=50": feed(ENTRY.format("5", "Something else", link(f"{BASE}/5.xml"))),
    f"{BASE}/atom.xml?query=Epsilon+Zeta&per_page=50": b"<feed",
    f"{BASE}/atom.xml?query=Eta+Theta&per_page=50": feed(ENTRY.format("6", "Eta v Theta", link(f"{BASE}/gone.xml"))),
}
FILES = [
    ("A_v_B__1932__UKHL_100__x.pdf", None, None), ("Alpha v Beta [1999] 1 AC.pdf", None, None), ("Alpha v  Beta.pdf", None, None), ("Gamma v Delta.pdf", None, None), ("Epsilon v Zeta.PDF", None, None),
    ("Eta v Theta.pdf", None, None), ("2.rtf", None, None), ("a.pdf", None, None), ("other.doc", "Alpha Beta", "ukhl/1900/1"), (None, None, None), ("Alpha v  Beta.pdf", None, None),
]


def asker(folder, pages):
    def opener(url):
        with open(f"{folder}/asked", "a") as file:
            file.write(f"{url}\n")
        return (200, pages[url]) if url in pages else (404, b"")

    return search.page_of(opener, 0, lambda seconds: None)


def test_files_find_their_judgments(spark, tmp_path):
    files = spark.createDataFrame(FILES, "name string, query string, uri string").repartition(3)
    store = fresh(spark, "case-pages")
    rows = search.file_title(search.found_cases(files, f"{BASE}/", store, asker(tmp_path, PAGES))).collect()
    got = sorted([(r.name or "", r.via, r.title, r.matched, r.xml, r.file, r.reason and r.reason.split(":")[0]) for r in rows], key=repr)
    second = ("search", "Beta v Alpha", 2, "<a>second é</a>", "Beta v Alpha", None)
    assert got == sorted([
        ("A_v_B__1932__UKHL_100__x.pdf", "uri", None, None, "<a>direct</a>", "A v B 1932 UKHL 100 x", None), ("Alpha v Beta [1999] 1 AC.pdf", *second), ("Alpha v  Beta.pdf", *second), ("Alpha v  Beta.pdf", *second), ("other.doc", *second),
        ("Gamma v Delta.pdf", None, None, None, None, None, "no title"), ("Epsilon v Zeta.PDF", None, None, None, None, None, "no title"), ("Eta v Theta.pdf", None, "Eta v Theta", 2, None, None, "OSError"),
        ("2.rtf", None, None, None, None, None, "no query"), ("a.pdf", None, None, None, None, None, "no query"), ("", None, None, None, None, None, "no query"),
    ], key=repr)
    log = Path(tmp_path, "asked").read_text().split()
    assert len(log) == len(set(log))  # every address once, however many files want it
    assert search.found_cases(files.drop("query", "uri").limit(0), BASE, store, asker(tmp_path, {})).count() == 0
    Path(tmp_path, "asked").write_text("")
    again = search.found_cases(files, BASE, store, asker(tmp_path, PAGES | {f"{BASE}/gone.xml": b"<a>late</a>"}))
    assert {r.xml for r in again.collect() if r.name == "Eta v Theta.pdf"} == {"<a>late</a>"}
    assert set(Path(tmp_path, "asked").read_text().split()) == {f"{BASE}/gone.xml", f"{BASE}/ukhl/1900/1/data.xml"}  # only what had failed


def test_a_sample_of_pages(spark, tmp_path):
    for folder in ("one/deep", "two"):
        Path(tmp_path, folder).mkdir(parents=True)
        for n in range(9):
            Path(tmp_path, folder, f"{n}.{('html', 'htm', 'HTM', 'txt')[n % 4]}").write_text(f"{folder} {n}")
    folders = [f"file://{tmp_path}/one", f"file://{tmp_path}/two"]
    assert xml.read_files(spark, folders, xml.PAGES).count() == 14
    one, two, other = (sorted(r.path for r in xml.sampled_files(spark, folders, 5, seed=seed).collect()) for seed in (1, 1, 2))
    assert len(one) == 5 and one == two != other
    assert xml.sampled_files(spark, folders, 50).count() == 14


def test_roles_as_a_page_that_is_read_back_has_them(spark):
    page = '<p class="doctrine-and-policy">One</p><p>Two</p><p class="para-facts">Three</p><p class="odd">Four</p>'
    frame = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [(r.text, r.role) for r in html.classified_paragraphs(frame, default="Reasoning", titled=True).collect()] == [("One", "Doctrine And Policy"), ("Two", "Reasoning"), ("Three", "Para Facts"), ("Four", "Odd")]
    assert [r.role for r in html.classified_paragraphs(frame).collect()] == ["Doctrine and Policy", "Facts"]

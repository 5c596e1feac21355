import io
import zipfile

import pytest

from casemill.functions import judgments
from casemill.sources import feed, html, office, publisher, storage, tables, xml

JUDGMENT = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><judgment><body>
<paragraph><num>1.</num><content><p>First <b>bold</b> paragraph.</p></content></paragraph><paragraph><content><p>short</p></content></paragraph>
<paragraph><num>3.</num><content><p>Third paragraph here.</p></content></paragraph></body></judgment></akomaNtoso>"""
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as file:
        file.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return buffer.getvalue()


def test_xml_paragraphs_keep_gaps_in_the_index(spark, tmp_path):
    folder = tmp_path / "Supreme Court (uksc)" / "majority"
    folder.mkdir(parents=True)
    (folder / "A v B [2001] UKSC 1.xml").write_text(JUDGMENT)
    (tmp_path / "Supreme Court (uksc)" / "other").mkdir()
    (tmp_path / "Supreme Court (uksc)" / "other" / "x.xml").write_text("<broken")
    files = xml.with_court(xml.read_files(spark, str(tmp_path)))
    assert [(r.doc_id, r.court) for r in files.collect()] == [("A v B [2001] UKSC 1", "UKSC")]
    rows = xml.paragraphs(files).orderBy("sentence_index").collect()
    assert [(r.sentence_index, r.section_number, r.text) for r in rows] == [(0, "1.", "First bold paragraph."), (2, "3.", "Third paragraph here.")]


def test_xml_variants():
    assert xml.judgment_paragraphs("<broken") == [] and xml.full_text("<a>x <b> y</b></a>") == "x y"
    long = "p" * 60
    assert xml.judgment_paragraphs(f"<d><p>{long}</p></d>", True) == [("unknown", long)]
    assert xml.simple_paragraphs("<document><body><p>a\x01b</p></body></document>") == [("1", "a b")]
    assert xml.lenient_paragraphs("<d>\n1. One\n2. Two</d>") == [("1", "One"), ("2", "Two")]
    assert len(xml.lenient_paragraphs(f"<d><paragraph><p>{long}</p></paragraph></d>")) == 2


def test_docx_rtf_and_zip(spark):
    content = docx("<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    assert office.docx_paragraphs(content) == ["One"]
    assert office.docx_paragraphs(docx("<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")) == ["cell"]
    assert office.docx_paragraphs(b"no zip") == []
    raw = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\title My Title}}First caf\'e9\par\par Second \{x\}\par}"
    assert office.rtf_paragraphs(raw) == ["First café", "Second {x}"] and office.rtf_title(raw) == "My Title"
    frame = spark.createDataFrame([("d", content)], "doc_id string, content binary")
    assert [tuple(r) for r in office.paragraphs(frame, "docx").collect()] == [("d", 0, "One")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as file:
        file.writestr("a.html", "<p>x</p>")
        file.writestr("b.txt", "no")
    assert [r.name for r in office.unzipped(spark.createDataFrame([("z", buffer.getvalue())], "path string, content binary")).collect()] == ["a.html"]


def test_html_scans(spark):
    page = '<h1>T</h1><p class="para-facts">The facts &amp; more.</p><p>No class here at all.</p><ul><li>one</ul><table><tr><td>a<td>b</tr></table><nav><p>menu</p></nav>'
    frame = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    text = {r.page_id: r.text for r in html.structured_text(frame).collect()}
    assert text[1] == "T\nThe facts & more.\nNo class here at all.\n- one\na | b" and text[2] == ""
    assert [(r.text, r.role) for r in html.classified_paragraphs(frame).collect()] == [("The facts &amp; more.", "Facts")]
    assert len(html.classified_paragraphs(frame, default="Reasoning").collect()) == 3
    assert html.extracted_paragraphs(frame).count() == 2
    back = html.classified_html(spark.createDataFrame([("d", 0, "a < b", "Facts")], "doc_id string, position int, text string, role string"))
    assert back.first().html == '<h1>d</h1>\n<p class="facts">a &lt; b</p>'
    law = "<p>" + "</p><p>".join(f"{n}. The paragraph number {n} of this case is somewhat longer than fifty characters." for n in range(1, 9)) + "</p>"
    assert html.case_law_paragraphs(spark.createDataFrame([(1, law * 1)], "page_id long, html string")).count() >= 5


def test_tables_and_reports(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text('Court/Opinion\tFile Name\tTest\nUKSC Majority\tA.xml\tsome "text"\twith tab\n\t\t\n')
    assert [tuple(r) for r in tables.read_queries(spark, str(path)).collect()] == [("UKSC Majority", "A.xml", 'some "text"\twith tab')]
    records = tmp_path / "r.tsv"
    records.write_text("head\tx\nUKSC\tm\tf\tp\tc\ttext\nmore\tn\nTribunal\tm\tf\tp\tc\tt\n")
    assert [(r.c0, r.c5) for r in tables.read_records(spark, str(records)).collect()] == [("UKSC", "text\nmore"), ("Tribunal", "t")]
    meta = tmp_path / "m.json"
    meta.write_text('{"A": {"short_name": "A v B", "year": "1990", "judges": ["X"], "title": "t"}}')
    assert tuple(tables.read_metadata(spark, str(meta)).first()) == ("A", "A v B", "1990", ["X"], "t")
    out = tmp_path / "out"
    tables.write_report(spark.createDataFrame([("a\tb", 'q"x')], "x string, y string"), str(out))
    assert tuple(tables.read_tsv(spark, str(out)).first()) == ("a b", 'q"x')
    good, bad = tables.split_valid(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>"), 2)
    assert ([r.id for r in good.collect()], sorted(r.id for r in bad.collect())) == ([1], [2, 3])


def test_feed_follows_pages(spark, tmp_path):
    def page(n, following):
        link = f'<link rel="next" href="{following}"/>' if following else ""
        return f'<feed xmlns="http://www.w3.org/2005/Atom">{link}<entry><id>{n}</id><title>Case {n}</title><updated>u</updated><link href="l{n}"/></entry></feed>'

    second = tmp_path / "2.xml"
    second.write_text(page(2, ""))
    first = tmp_path / "1.xml"
    first.write_text(page(1, f"file://{second}"))
    feed.register(spark)
    read = spark.read.format("casemill_atom")
    assert [r.title for r in read.load(f"file://{first}").collect()] == ["Case 1", "Case 2"]
    assert read.option("maxEntries", 1).load(f"file://{first}").count() == 1
    answers, waits = iter([(429, b""), (500, b""), (200, b"ok")]), []
    assert feed.fetch("u", lambda _: next(answers), pause=waits.append) == b"ok" and waits == [60, 30]
    with pytest.raises(OSError):
        feed.fetch("u", lambda _: (404, b""))


def test_publisher_pages():
    page = (
        "<html><head><title>A v. B, Court Opinion 3</title></head><body><input id='doc_id' value='X1'><div class='citation-group'><i class='cite'>2 U.S. 1</i><i class='cite'>1 U.S.\n 9</i></div>"
        "<div id='content_document'><center>Supreme Court</center><center>March 3, 1999</center><div class='headnotesContainer'><p class='headnote_text'>Only text.</p></div>"
        "<h1 class='organization'>Facts</h1><p>one</p><p>two</p><h1 class='organization'>Empty</h1><h1 class='organization'>Held</h1><div>three</div><div id='contentMajOp'>four</div></div></body></html>"
    )
    found = publisher.parse_case(page)
    assert (found["doc_id"], found["case_name"], found["court"], found["date"]) == ("X1", "A v. B", "Supreme Court", "March 3, 1999")
    assert found["citations"] == ["1 U.S. 9", "2 U.S. 1"] and found["headnotes"] == [{"slug": "", "text": "Only text."}]
    assert found["sections"] == [{"title": "Facts", "text": "one two"}, {"title": "Held", "text": "three four"}] and found["majority_opinion"] == "four"
    assert publisher.parse_case("")["sections"] == [{"title": "Opinion", "text": ""}] and publisher.parse_case(None)["case_name"] is None


def test_sinks_can_be_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("A", "uksc", "majority", 2, "x < y"), ("A", "uksc", "majority", 1, "first"), ("B", "eat", "concurring", 1, "other")], "doc_id string, court string, decision string, position int, text string")
    tables.write_partitioned(rows, str(tmp_path / "parts"))
    again = spark.read.parquet(str(tmp_path / "parts"))
    assert again.where("court = 'eat'").count() == 1 and sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == ["court=eat", "court=uksc"]
    tables.write_metadata(rows.select("doc_id", "court"), str(tmp_path / "meta"))
    assert sorted(r.court for r in spark.read.json(str(tmp_path / "meta")).collect()) == ["eat", "uksc", "uksc"]
    simple = {r.doc_id: r.xml for r in xml.to_simple_xml(rows).collect()}
    assert [text for _, text in xml.simple_paragraphs(simple["A"])] == ["first", "x < y"]


def test_docx_sentences(spark):
    body = "<w:p><w:r><w:t>One sentence stands here. Short. Another one stands v. here too!</w:t></w:r></w:p><w:p><w:r><w:t>The next paragraph goes on.</w:t></w:r></w:p>"
    files = spark.createDataFrame([("d", bytearray(docx(body)))], "doc_id string, content binary")
    assert [(r.position, r.text) for r in office.sentences(files).orderBy("position").collect()] == [(0, "One sentence stands here."), (1, "Another one stands v."), (2, "here too!")][:2] + [(2, "The next paragraph goes on.")]


def test_court_configuration(spark):
    config = judgments.CourtConfig.from_json('{"courts": [{"name": "High Court", "code": "EWHC", "structure": "unitary", "pattern": "EWHC \\\\d+"}], "settings": {"country_code": "EW"}}')
    frame = spark.createDataFrame([("[2001] EWHC 5",), ("[2001] UKSC 5",)], "t string")
    assert [r.c and r.c.code for r in frame.select(config.court_of(frame.t).alias("c")).collect()] == ["EWHC", None]
    assert [r.c and r.c.code for r in frame.select(judgments.CourtConfig().court_of(frame.t).alias("c")).collect()] == [None, "UKSC"]
    assert config.settings == {"country_code": "EW", "citation_style": "neutral"} and config.judge_header == judgments.JUDGE_HEADER


def test_tables_columns_and_versions(spark, tmp_path):
    name = "units_for_test"
    try:
        for _ in range(2):
            storage.create_table(spark, name, {c: storage.UNITS[c] for c in ("doc_id", "text", "court")}, f"file://{tmp_path}/units", by=("court",))
        spark.sql(f"INSERT INTO {name} VALUES ('a', 'text', 'UKSC')")
        assert storage.add_missing_columns(spark, name, {"embedding": "ARRAY<FLOAT>", "text": "STRING"}) == ["embedding"]
        assert storage.add_missing_columns(spark, name, storage.UNITS)[:1] == ["section_title"] and spark.table(name).first().embedding is None
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([(1, "A"), (2, None)], "id int, text string").write.parquet(f"{tmp_path}/cells/v=0")
    for _ in range(2):
        after = storage.rewritten(spark, f"{tmp_path}/cells", 1, lambda rows: rows.fillna({"text": "?"}))
    assert sorted(tuple(r) for r in after.collect()) == [(1, "A"), (2, "?")] and spark.read.parquet(f"{tmp_path}/cells/v=0").where("text IS NULL").count() == 1


def test_feed_search_picks_the_best_title():
    found = [("1", "Smith v Jones", "", ""), ("2", "Donoghue v Stevenson", "", ""), ("3", "Stevenson", "", "")]
    assert feed.best_entry(found, "Stevenson, Donoghue 1932") == (found[1], 2)
    assert feed.best_entry(found, "zzz") == (None, 0) and feed.best_entry([], "x") == (None, 0) and feed.best_entry(found, "a") == (found[0], 0)


def test_rows_of_another_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    try:
        spark.range(100).withColumnRenamed("id", "K").write.format("jdbc").options(url=url, dbtable="UNITS").save()
    except Exception as error:  # noqa: BLE001  Spark's own copy of the driver may be missing
        pytest.skip(f"no driver: {type(error).__name__}")
    rows = storage.read_sql(spark, url, "UNITS", key="K", bounds=(0, 100), parts=4)
    assert rows.rdd.getNumPartitions() == 4 and sorted(r.K for r in rows.collect()) == list(range(100))

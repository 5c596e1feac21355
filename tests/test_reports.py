import csv

import pytest

from casemill.operators import reports

SENTENCES = [
    ("Alpha v Beta [1999]", 0, 0, "The duty was settled in Smith v. Jones at length"), ("Alpha v Beta [1999]", 0, 1, "As was said by the court in Smith v. Jones (at p. 12) it goes on"),
    ("Gamma v Delta", 1, 0, "It was held, at p. 381, that nothing followed from it"), ("Gamma v Delta", 1, 1, "the DUTY was   settled in Brown v. White anyway"),
]
HEAD = ["File", "Top Suggestion", "Suggestion 1 Citation", "Suggestion 2 Text", "Suggestion 2 Citation", "Suggestion 3 Text", "Suggestion 3 Citation"]
ROWS = [
    ["a", "The duty was settled in Smith v.", "alpha v beta [1999]", "It was held, at p.", "Gamma v  Delta", "short v.", "Gamma v Delta"],
    ["b", "The duty was settled in Smith v. Jones at length (Alpha v Beta [1999])", "Alpha v Beta [1999]", "said by the court in Smith v.", "Alpha v Beta [1999]", "The duty was settled in Brown v.", "Gamma v Delta"],
    ["c", "Nobody ever said so in Smith v.", "Alpha v Beta [1999]", "It was held and more, at p.", "Unknown", None, None],
    ["c", "The duty was settled in Smith v.", "", "said by the court in Smith v.", "", "", "Gamma v Delta"],
]
WHOLE = [
    ["a", "The duty was settled in Smith v. Jones at length (alpha v beta [1999])", "alpha v beta [1999]", "It was held, at p.", "Gamma v  Delta", "short v.", "Gamma v Delta", 1],
    ["b", ROWS[1][1], "Alpha v Beta [1999]", SENTENCES[1][3], "Alpha v Beta [1999]", SENTENCES[3][3], "Gamma v Delta", 2],
    [*ROWS[2], 0], [*ROWS[3], 0],
]


def sentences(spark):
    return spark.createDataFrame(SENTENCES, "document string, rank int, position int, sentence string")


def test_cut_cells_are_made_whole(spark):
    report = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, " + ", ".join(f"`{c}` string" for c in HEAD))
    found = reports.repaired_report(report, sentences(spark), ["n"]).orderBy("n").collect()
    assert [list(r)[1:] for r in found] == WHOLE
    again = reports.repaired_report(report.withColumn("__repaired", report["n"]), sentences(spark), ["n"])
    assert again.columns == ["n", *HEAD, "__repaired"] and again.agg({"__repaired": "sum"}).first()[0] == 3
    assert reports.repaired_report(report.limit(0), sentences(spark), ["n"]).count() == 0
    assert reports.repaired_report(report, sentences(spark).limit(0), ["n"]).agg({"__repaired": "sum"}).first()[0] == 0
    with pytest.raises(ValueError, match="suggestions"):
        reports.repaired_report(report.select("n", "File"), sentences(spark), ["n"])


def test_rows_that_repeat_a_null_key_are_repaired_alike(spark):
    report = spark.createDataFrame([(None, *ROWS[0]), (1, *ROWS[0])], "n int, " + ", ".join(f"`{c}` string" for c in HEAD))
    assert [r["__repaired"] for r in reports.repaired_report(report, sentences(spark), ["n"]).collect()] == [1, 1]


def write(path, head, rows):
    with open(path, "w", encoding="utf-8", newline="") as file:
        csv.writer(file, delimiter="\t", quoting=csv.QUOTE_ALL).writerows([head, *[[c or "" for c in r] for r in rows]])


def read(folder):
    rows = []
    for path in sorted(folder.glob("part-*.csv")):
        with open(path, encoding="utf-8", newline="") as file:
            rows += list(csv.reader(file, delimiter="\t"))
    return rows


def test_report_files_are_rewritten_as_a_new_version(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "one.tsv", HEAD, ROWS * 3)
    write(tmp_path / "in" / "two+x.tsv", HEAD[:5], [r[:5] for r in ROWS])
    counts = reports.rewrite_reports(spark, f"file://{tmp_path}/in", sentences(spark), f"file://{tmp_path}/out")
    assert {r["file"]: r["repaired"] for r in counts.collect()} == {"one": 9, "two+x": 2}
    assert read(tmp_path / "out" / "report_file=one") == [HEAD, *[[c or "" for c in r[:-1]] for r in WHOLE * 3]]
    assert read(tmp_path / "out" / "report_file=two+x") == [HEAD[:5], *[[c or "" for c in r[:5]] for r in WHOLE]]
    assert len((tmp_path / "in" / "one.tsv").read_text().splitlines()) == 13

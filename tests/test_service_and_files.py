import json
import sys

import pandas as pd

from pyspark import cloudpickle

from casemill.functions import judgments
from casemill.functions import text as tx
from casemill.models import embedded
from casemill.operators import service, vector_index
from casemill.scratch import fresh
from casemill.sources import tables
from pyspark.sql import functions as F


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def letters(texts):
    import pandas

    return pandas.Series([[float((t or "").count(c)) for c in "abcde"] for t in texts])


def units(spark):
    rows = [(n, n // 5, "Main", n % 5, text, "Facts" if n % 2 else "Reasoning") for n, text in enumerate(["aaa", "ab", "bbb", "", None, "ccd", "cd", "dde", "e", "aab"])]
    return spark.createDataFrame(rows, "id long, doc_id long, section_title string, sentence_index int, text string, label string")


def test_texts_in_hits_with_neighbours_out(spark):
    asked = spark.createDataFrame([("q1", "a"), ("q2", "d"), ("blank", " "), ("none", None)], "query_id string, text string")
    found = {(r.query_id, r["rank"]): r for r in service.retrieve(asked, units(spark), letters, 2).collect()}
    assert sorted(found) == [("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2)]
    first = found["q1", 1]
    assert (first.hit_id, first.target_text, first.previous_text, first.next_text, round(first.similarity, 6)) == (0, "aaa", "", "ab", 1.0)
    assert found["q1", 2].hit_id == 9 and found["q2", 1].hit_id == 7
    filtered = [r.hit_id for r in service.retrieve(asked.where("query_id = 'q1'"), units(spark), letters, 3, label="Facts", threshold=0.5, offset=1).orderBy("rank").collect()]
    assert filtered == [9, 1]
    moved = {r.hit_id: r.target_text for r in service.retrieve(asked.where("query_id = 'q1'"), units(spark), letters, 2, offset=1).collect()}
    assert moved == {0: "ab", 9: ""}


def test_an_index_gives_the_same_hits(spark):
    corpus = embedded(units(spark), F.col("text"), letters).select("id", "embedding")
    index = vector_index.build(corpus, fresh(spark, "service"))
    asked = spark.createDataFrame([("q1", "ab"), ("q2", "de")], "query_id string, text string")
    for label in (None, "Facts"):
        one, two = (sorted((r.query_id, r["rank"], r.hit_id) for r in service.retrieve(asked, units(spark), letters, 3, label=label, threshold=0.1, index=i).collect()) for i in (None, index))
        assert one == two


def test_files_and_lines_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("A v B [1999] X/1", "one\né"), ("C: D", "two"), ("C: D", "three"), (None, "x"), ("e", None)], "name string, text string").repartition(3)
    assert tables.write_files(rows, str(tmp_path / "out"), "name", "text") == 2
    assert tables.write_files(rows, str(tmp_path / "out"), "name", "text") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"A_v_B_[1999]_X_1.md": "one\né", "C_D.md": "two"}
    tables.write_jsonl(rows.coalesce(1), str(tmp_path / "lines"))
    lines = [json.loads(line) for p in (tmp_path / "lines").glob("part-*") for line in p.read_text().splitlines()]
    assert len(lines) == 5 and {"name": "e", "text": None} in lines


def test_sections_follow_the_configuration(spark):
    config = judgments.CourtConfig.from_json(json.dumps({"sections": {"facts": "(?i)sachverhalt", "dissent": "(?i)abweichend"}}))
    rows = spark.createDataFrame([("Sachverhalt\nx", 3), ("Background facts", 3), ("For these reasons it ends", 30), ("Ich bin abweichend", 2)], "t string, n int")
    got = [tuple(r) for r in rows.select(config.section_of(F.col("t"), F.col("n"), F.lit(True)), config.dissents(F.col("t"), F.col("n"))).collect()]
    assert got == [("facts", False), ("analysis", False), ("conclusion", False), ("analysis", True)]
    try:
        judgments.CourtConfig.from_json('{"sections": {"other": "x"}}')
    except ValueError as error:
        assert "other" in str(error)
    else:
        raise AssertionError


def test_the_time_is_utc(spark):
    value = spark.range(1).select(tx.utc_now_iso()).first()[0]
    assert abs((pd.Timestamp(value) - pd.Timestamp.now("UTC")).total_seconds()) < 120 and value.endswith("+00:00")


def test_predicates_agree_with_their_whole_patterns(spark):
    texts = [
        "Times New Roman; and a good deal of other text here", "heading 3 Something that goes on for some time", "* . * . * and more of the same thing here now", " ;;;...((())) ;;;...((())) ;;;...((()))", "A Law1 Law2 mark in a text of some length",
        "THE SUPREME COURT", "Walsh J.", "JUDGMENT of Mr Justice X delivered on the 4th of May in the year 1999 at the Four Courts", "x THE SUPREME COURT", "and", "As was held in Donoghue v.", "the passage cited above at p.", "see this in full. 381 U.S.", "plain text that ends here. And it is long enough for anything", None, "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    s = tx.strip(tx.or_empty(F.col("t")))
    low = F.lower(s)
    styled = (F.length(low) - F.length(F.replace(low, F.lit(";"), F.lit(""))) >= 3) & low.rlike("|".join(tx.STYLE_WORDS))
    formatting = (F.length(s) >= 30) & (s.rlike("(?i)" + tx.any_of(tx.FORMATTING)) | styled)
    bad = (F.length(s) < 50) | s.rlike("(?i)" + tx.any_of(tx.BAD_CONTEXT)) | ((F.upper(s) == s) & (F.length(s) < 80))
    cut = (F.length(tx.or_empty(F.col("t"))) >= 20) & s.rlike(tx.any_of(tx.TRUNCATED))
    for ours, whole in ((tx.is_formatting, formatting), (tx.is_bad_context, bad), (tx.is_truncated, cut)):
        assert [tuple(r) for r in rows.select("t", ours(F.col("t"))).collect()] == [tuple(r) for r in rows.select("t", whole).collect()]

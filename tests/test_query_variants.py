"""The four query forms of a row with a summary and of one without."""

import __spark_entry__ as entry_module


def test_a_row_has_all_four_forms_with_and_without_a_summary(spark, tmp_path):
    given = {
        "documents": ([(1, " one ", "en", "s1"), (2, "two", "de", "s1")], "doc_id long, text string, lang string, source string"),
        "labels": ([(1, 1), (2, 0)], "doc_id long, quality int"),
        "conversations": ([(1, 1, "later"), (1, 0, "first")], "conv_id long, turn int, text string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.doc_id, r.variant): r.query for r in entry_module.queries()["query_variants"](spark, str(tmp_path)).collect()}
    one, two = (f"In re s1 1901 Judges: DE. {text}" for text in ("one", "two"))
    assert got == {
        (1, "v1"): "[Reasoning] one", (1, "v2"): f"[Reasoning] {one} one", (1, "v3"): "[Reasoning] first one", (1, "v4"): f"[Reasoning] {one} one",
        (2, "v1"): "[Facts] two", (2, "v2"): f"[Facts] {two} two", (2, "v3"): "[Facts] two", (2, "v4"): f"[Facts] {two} two",
    }

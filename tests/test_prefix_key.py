import __spark_entry__ as entry_module


def test_texts_that_begin_alike_stay_apart(spark, tmp_path):
    head = "h" * 300
    rows = [(1, "a", head + "x"), (2, "a", head + "y"), (3, "b", head + "x"), (4, "a", head + "x"), (5, None, None), (6, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry_module.queries()["prefix_dedup_source"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 2), (2, 1), (3, 1), (5, 2)]

from casemill.plans import text_queries


def test_every_short_item_is_compared(spark, tmp_path):
    items = [(n, f"w{n}x") for n in range(1200)] + [(2000, ""), (2001, "two words"), (2002, "one inner word"), (2003, None)]
    docs = [(n, f"w{n}x, two words") for n in range(1200)] + [(5000, "say one inner word"), (5001, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.item_id, r.tier) for r in text_queries.benchmark_containment(spark, str(tmp_path)).collect())
    expected = [(d, i, 1 if text.startswith(item) else 2) for d, text in docs if text for i, item in items if item is not None and item in text]
    assert found == sorted(expected)

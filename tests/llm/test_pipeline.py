import corpus_pipeline
from llm.helpers import jaccard_components, near_copies

from casemill.llm import toxicity
from casemill.llm.mixing import word_count


def test_stages_against_brute_force(spark, tmp_path):
    texts = near_copies(seed=5)
    rows = [(n, t, "en", f"s{n % 4}", len(t) if t is not None else None) for n, t in enumerate(texts)]
    rows += [(900, "you idiot moron, you stupid worthless clown", "en", "s0", 42), (901, "a clean first line of some length\nshared line of more than a few words", "en", "s1", 70), (902, "shared line of more than a few words\nand a line of its own, quite long", "en", None, 70), (903, "shared line of more than a few words", "en", "s1", 36)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 0, 0) for n in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "source_mix", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, str(folder))
    clean_rows = {r.doc_id: r for r in clean.collect()}
    assert 900 not in clean_rows and len(clean_rows) == len(rows) - 1 and clean.columns == docs.columns

    lined = {r.doc_id: r for r in stages["line_dedup"](spark, clean, str(folder)).collect()}
    assert lined[902].text == "and a line of its own, quite long" and lined[902].n_chars == len(lined[902].text)
    assert 903 not in lined and lined[901].text == clean_rows[901].text

    near = stages["ngram_join"](spark, clean, str(folder))
    pairs = [(r.doc_id, r.text) for r in clean_rows.values()]
    expected = sorted(k for (k, _), (_, c) in zip(pairs, jaccard_components(pairs, 5, 80), strict=True) if c == k)
    assert sorted(r.doc_id for r in near.collect()) == expected and near.columns == docs.columns

    mixed = stages["source_mix"](spark, near, str(folder))
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= set(expected)
    assert mixed.select(word_count(toxicity.text_of("text")).alias("n")).agg({"n": "sum"}).first()[0] > 0

    pieces = corpus_pipeline.run(spark, str(folder)).collect()
    assert pieces and all(p.offset + p.length <= 2048 for p in pieces)


def test_empty_table(spark, tmp_path):
    folder = tmp_path / "sf"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, str(folder)).count() == 0

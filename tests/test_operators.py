import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill import models
from casemill.functions import text as tx
from casemill.operators import cases, chunking, greedy, relational, retrieval
from casemill.streaming import ingest


def test_context_follows_the_index_and_not_the_neighbours(spark):
    units = spark.createDataFrame([(10, "A", "Main", 0, "t0"), (11, "A", "Main", 1, "t1"), (13, "A", "Main", 3, "t3"), (14, "A", "Main", 3, "copy")], "id long, doc_id string, section_title string, sentence_index int, text string")
    rows = {r.hit_id: r for r in retrieval.with_context(units, units.select("id")).collect()}
    assert (rows[11].next_id, rows[11].previous_id, rows[13].previous_id, rows[10].next_id) == (-1, 10, -1, 11)
    ahead = {r.hit_id: (r.target_id, r.next_id) for r in retrieval.with_context(units, units.select("id"), offset=2).collect()}
    assert ahead[11] == (13, -1) and ahead[10] == (-1, -1)


def test_batch_search_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(n, vectors[n].tolist(), n % 4) for n in range(120)] + [(500, None, 1), (501, [0.0] * 8, 1)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(5)
    queries = corpus.where("id < 7").withColumnRenamed("id", "query_id")
    for metric in ("ip", "cosine"):
        x = vectors.astype(float)
        scores = x @ x.T
        if metric == "cosine":
            scores /= np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        got = {(r.query_id, r["rank"]): r.id for r in retrieval.top_k(corpus, queries, 5, metric, same="label").collect()}
        for q in range(7):
            allowed = [n for n in range(120) if n % 4 == q % 4 and n != q] + ([501] if metric == "ip" and q % 4 == 1 else [])
            best = sorted(allowed, key=lambda n: (-(scores[q][n] if n < 120 else 0.0), n))[:5]
            assert [got[(q, k)] for k in range(1, 6)] == best


def test_greedy_filter_invariants(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest of the north " * 3
    rows = [(1, n, text) for n, text in enumerate([base, base, base[:150] + "x" * 200, "y" * 100, base[30:], "", "short one", "short two"], 1)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, core string")
    kept = [r["rank"] for r in greedy.keep_distinct_hits(hits, 3).orderBy("rank").collect()]
    assert kept == [1, 4, 7]


def test_sticky_dissent_and_carry(spark):
    rows = [(1, n, n in (9,)) for n in range(8, 12)] + [(2, n, n == 10) for n in range(8, 12)]
    frame = spark.createDataFrame(rows, "doc int, n int, marker boolean")
    flag = F.col("marker") & (F.col("n") < 10)
    found = {(r.doc, r.n): r.s for r in frame.withColumn("s", relational.sticky(flag, ["doc"], ["n"])).collect()}
    assert [found[(1, n)] for n in range(8, 12)] == [0, 1, 1, 1] and [found[(2, n)] for n in range(8, 12)] == [0] * 4


def test_chunks_keep_text_and_bounds(spark):
    sentence = "This is a sentence of some length that goes on. "
    paragraphs = [sentence * 60, "tiny", "", "  ", None, sentence * 3, "w" * 50, sentence * 30, "x" * 1300]
    frame = spark.createDataFrame([(1, paragraphs), (2, []), (3, None)], "doc_id int, paragraphs array<string>")
    for cut in (chunking.pack_chunks, chunking.even_chunks):
        rows = cut(frame).orderBy("doc_id", "chunk_index").collect()
        assert {r.doc_id for r in rows} == {1}
        assert "".join("".join(r.chunk for r in rows).split()) == "".join("".join(p or "" for p in paragraphs).split())
        assert all(len(r.chunk) <= chunking.EVEN_MERGE for r in rows if " " in r.chunk)


def test_sentences_end_at_no_abbreviation(spark):
    text = "Held in A v. B by Mr. Smith, e.g. there. It was p. 4! Was it?  Yes v.\nNo. 5 is one. Co. X"
    found = spark.createDataFrame([(text,)], "t string").select(tx.sentences(F.col("t"), 1).alias("s")).first().s
    assert found == ["Held in A v. B by Mr. Smith, e.g. there.", "It was p. 4!", "Was it?", "Yes v.", "No.", "5 is one.", "Co. X"]


def test_names_match_by_prefix_without_a_shared_first_word(spark):
    targets = spark.createDataFrame([("Smithson",), ("Zz",)], "target string")
    names = spark.createDataFrame([("Smithsonian v X", 1), ("Other", 2)], "name string, rank int")
    assert [tuple(r) for r in relational.resolve_names(targets, names).collect()] == [("Smithson", "Smithsonian v X", 2)]


def test_documents_match_by_name(spark):
    names = spark.createDataFrame([("The long case name v Other [2001] AC 1",), ("short",), ("none of these at all",)], "name string")
    documents = spark.createDataFrame([("x the long case name v other [2001] ac 1 and more", 2), ("Short", 1), ("The Long  Case Name v Other", 3)], "document string, rank int")
    found = {r.name: r.document for r in cases.matched_documents(names, documents).collect()}
    assert found == {"The long case name v Other [2001] AC 1": "x the long case name v other [2001] ac 1 and more", "short": "Short"}


def test_numbers_are_dense_over_ranges(spark):
    frame = spark.range(0, 1000, 7).repartition(5)
    rows = relational.numbered(frame, "id", 50).orderBy("id").collect()
    assert [r.number for r in rows] == list(range(50, 50 + len(rows)))
    assert relational.numbered(frame.limit(0), "id").count() == 0


def test_shortener_stops_and_never_mixes_rows(spark):
    texts = ["The court finally held that the claim should be dismissed on the facts of the case", "", None, "word"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {r.id: r for r in models.shorten(frame).collect()}
    assert len(out[0].short) < len(texts[0]) and 1 <= out[0].rounds <= 3
    assert out[1].short == "" and out[2].short is None and out[3].short == "word"


def test_embedder_keeps_rows_and_blank_is_zero(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a b")], "id int, text string")
    rows = {r.id: r.embedding for r in models.embedded(frame, F.col("text"), models.HashingEmbedder(16)).collect()}
    assert rows[1] == rows[4] and sum(x * x for x in rows[1]) == pytest.approx(1) and set(rows[2]) == set(rows[3]) == {0.0}
    assert frame.select(models.role_of(F.lit("The appeal is dismissed")).alias("r")).first().r in tx.ROLES


def test_stream_ingests_each_key_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a"), (1, "again"), (2, "b")], "k int, v string").coalesce(1).write.parquet(source)
    for extra in (None, [(2, "late"), (3, "c")]):
        if extra:
            spark.createDataFrame(extra, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v string").parquet(source)
        ingest.ingest_once(spark, stream, target, mark, "k")
    assert sorted(r.k for r in spark.read.parquet(f"{target}/batch=*").collect()) == [1, 2, 3]


def test_roles_in_batches(spark):
    texts = ["The appeal is dismissed", "The plaintiff fell\nover 2. Facts", None, "x" * 500 + " principle", "a duty of care"] * 9
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.role for r in models.classified(frame).collect()}
    wanted = {r.id: r.r for r in frame.select("id", models.role_of(F.substring(F.coalesce("text", F.lit("")), 1, 400)).alias("r")).collect()}
    assert found == wanted
    assert models.parsed_roles("1. facts here\n2) nonsense\n1. the Judgment", 3) == ["Judgment", "Reasoning", "Reasoning"]
    assert models.corrected(["a", "b", "c"], "[1]\none two\n[2] zwei") == ["one two", "zwei", "c"]
    fixed = models.without_typos(frame.limit(7), lambda prompt: prompt.replace("appeal", "APPEAL")).collect()
    assert all(r.corrected == (r.text or "").replace("appeal", "APPEAL").strip() for r in fixed)


def test_providers_take_turns():
    waits, calls = [], []

    def busy(prompt):
        calls.append(prompt)
        raise models.Busy

    def broken(prompt):
        raise OSError("gone")

    ask = models.first_that_answers(busy, broken, str.upper, pause=waits.append)
    assert ask("yes") == "YES" and waits == [5.0, 10.0, 20.0] and calls == ["yes"] * 3
    with pytest.raises(RuntimeError):
        models.first_that_answers(broken)("x")


def test_similarity_of_documents(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b", "c d"), (3, "", "a"), (4, "w " * 5000, "w " * 3000)], "id int, left string, right string")
    found = {r.id: r.similarity for r in models.document_similarity(pairs, models.HashingEmbedder(512)).collect()}
    assert found[1] == 1.0 and found[2] < 0.5 and found[3] is None and found[4] == 1.0

import datetime
import os

import pytest

import __spark_entry__ as entry_module
from casemill.operators import retrieval

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_every_twentieth_id_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    wanted = {r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert len(wanted) > 7
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 30)
    for name in ("knn_batch_topk", "best_match_per_group"):
        assert {r.query_id for r in entry_module.queries()[name](spark, FOLDER).collect()} == wanted


def test_ids_of_any_type_ties_nulls_and_labels(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [1.0, 0.0], "x"), ("c", [1.0, 0.0], None), ("d", [0.0, 1.0], "y"), (None, [1.0, 0.0], "x"), ("e", None, "x")]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>, label string").repartition(3)
    queries = spark.createDataFrame([("a", [2.0, 0.0], "x"), (None, [0.0, 1.0], "y"), ("z", None, "x")], "query_id string, embedding array<float>, label string")
    got = sorted((r.query_id or "", r.id or "", r.score, r["rank"]) for r in retrieval.top_k(corpus, queries, 2).collect())
    assert got == [("", "", 0.0, 2), ("", "d", 1.0, 1), ("a", "", 2.0, 1), ("a", "b", 2.0, 2)]
    same = sorted((r.query_id or "", r.id or "") for r in retrieval.top_k(corpus, queries, 5, same="label").collect())
    assert ("a", "b") in same and ("a", "c") not in same and ("", "d") in same
    assert retrieval.top_k(corpus.limit(0), queries, 2).count() == 0 and retrieval.top_k(corpus, queries.limit(0), 2).count() == 0


@pytest.mark.parametrize(("kind", "values"), [("int", [1, 2, 3]), ("long", [1, 2, 3]), ("double", [0.5, 1.5, 2.5]), ("string", ["a", "b", "c"]), ("date", [datetime.date(2020, 1, n) for n in (1, 2, 3)]), ("timestamp", [datetime.datetime(2020, 1, n) for n in (1, 2, 3)])])
def test_ids_keep_their_type(spark, kind, values):
    rows = list(zip(values, [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]], ["x", "y", None], strict=True))
    corpus = spark.createDataFrame(rows, f"id {kind}, embedding array<float>, label string")
    queries = corpus.withColumnRenamed("id", "query_id")
    found = retrieval.top_k(corpus, queries, 1, "cosine")
    assert dict(found.dtypes)["id"] == dict(found.dtypes)["query_id"] == dict(corpus.dtypes)["id"]
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(values[0], values[1]), (values[1], values[0]), (values[2], values[1])]
    best = retrieval.best_per_label(corpus, queries, "label")
    assert {(r.query_id, r.label): round(r.best, 6) for r in best.collect()}[values[0], "y"] == 0.8
    assert best.where("label IS NULL").count() == 2


def test_a_query_meets_vectors_of_its_length_only(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [2.0, 0.0]), (4, []), (5, [3.0, 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(10, [1.0, 0.0, 1.0]), (11, [1.0, 1.0]), (12, [1.0] * 5)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.id, r.score) for r in retrieval.top_k(corpus, queries, 5).collect())
    assert got == [(10, 5, 4.0), (11, 1, 1.0), (11, 3, 2.0)]


def test_one_query_equals_the_batch_of_one(spark):
    corpus = spark.createDataFrame([(n, [float(n % 7), float(n % 5 - 2), 1.0]) for n in range(40)], "id long, embedding array<double>")
    queries = corpus.where("id = 3").withColumnRenamed("id", "query_id")
    vector = list(queries.first()["embedding"])
    for metric, threshold in (("ip", None), ("cosine", 0.5)):
        one = [(r.id, round(r.score, 9)) for r in retrieval.top_k_one(corpus, vector, 6, metric, threshold).collect()]
        batch = retrieval.top_k(corpus, queries, 6, metric, threshold, drop_self=False).orderBy("rank").collect()
        assert one == [(r.id, round(r.score, 9)) for r in batch]

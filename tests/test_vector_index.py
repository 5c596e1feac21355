import os

import numpy as np
import pytest

from casemill.operators import retrieval, vector_index
from casemill.scratch import fresh

FOLDER = "/root/testdata/sf0.1"


def frame(spark, vectors, labels=None):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "id long, embedding array<double>").repartition(4)


def clustered(n, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    return centres[rng.integers(0, 25, n)] + 0.35 * rng.normal(size=(n, dim))


def hits(found):
    return {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in found.collect()}


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_all_lists_give_the_exact_search_and_few_lists_most_of_it(spark, metric):
    corpus = frame(spark, clustered(1500))
    queries = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(corpus, fresh(spark, "index"), metric)
    assert 20 <= len(index.centroids) <= 40
    exact = hits(retrieval.top_k(corpus, queries, 10, metric))
    assert hits(vector_index.search(index, queries, 10, probes=len(index.centroids))) == exact
    again = vector_index.open_index(spark, index.path)
    found = {(q, i) for (q, _), (i, _) in hits(vector_index.search(again, queries, 10)).items()}
    wanted = {(q, i) for (q, _), (i, _) in exact.items()}
    assert len(found & wanted) >= 0.9 * len(wanted)
    if metric == "cosine":
        assert vector_index.scanned_share(index, queries) < 0.5


def test_every_row_is_indexed_once_and_a_hot_list_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 50)
    same = np.tile([1.0, 0.0, 0.0, 0.0], (600, 1))
    vectors = np.concatenate([same, np.random.default_rng(1).normal(size=(600, 4))])
    index = vector_index.build(frame(spark, vectors), fresh(spark, "index"))
    blocks = index.blocks().selectExpr("list", "size(ids) AS n", "ids").collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(1200))
    assert max(b["n"] for b in blocks) <= 50
    queries = frame(spark, same[:1]).withColumnRenamed("id", "query_id")
    assert [r.id for r in vector_index.search(index, queries, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_null_zero_and_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.6, 0.8])]
    corpus = spark.createDataFrame(rows, "id int, embedding array<float>")
    index = vector_index.build(corpus, fresh(spark, "index"))
    queries = spark.createDataFrame([("q", [1.0, 0.1]), ("none", None), ("long", [1.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in vector_index.search(index, queries, 5, drop_self=False).orderBy("rank").collect()]
    assert got == [("q", 1, 1), ("q", 5, 2)]
    empty = vector_index.build(corpus.where("false"), fresh(spark, "index"))
    assert vector_index.search(empty, queries.where("query_id = 'q'"), 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], corpus.schema), fresh(spark, "index"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_recall_on_the_given_table(spark):
    corpus = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    queries = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(corpus, fresh(spark, "index"))
    exact = {(q, i) for (q, _), (i, _) in hits(retrieval.top_k(corpus, queries, 10, "cosine")).items()}
    found = {(q, i) for (q, _), (i, _) in hits(vector_index.search(index, queries, 10)).items()}
    share = vector_index.scanned_share(index, queries)
    print("lists", len(index.centroids), "probes", index.probes, "recall", len(found & exact) / len(exact), "scanned", share)
    assert len(found & exact) >= 0.9 * len(exact)

import functools
import math

import numpy as np
import pytest

from casemill.operators import retrieval, table_functions


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_lateral_calls_equal_the_batch_search(spark, metric):
    rows = [(n, [float(n % 5 - 2), float(n % 3), 1.0 if n % 7 else 0.0], f"l{n % 4}") for n in range(60)] + [(100, None, "x"), (101, [1.0], "x"), (102, [float("nan"), 1.0, 0.0], "x"), (103, [0.0, 0.0, 0.0], "x")]
    units = spark.createDataFrame(rows, "id long, embedding array<double>, label string")
    units.createOrReplaceTempView("test_units")
    table_functions.register_match(spark, "match_test", "test_units", metric)
    threshold = "0.2D" if metric == "cosine" else "NULL"
    found = spark.sql(f"SELECT q.id AS query_id, m.id, m.label, round(m.similarity, 9) AS similarity, m.rank FROM test_units q, LATERAL match_test(q.embedding, {threshold}, 4, q.id) m WHERE q.id < 20")
    queries = units.where("id < 20").withColumnRenamed("id", "query_id")
    exact = retrieval.top_k(units, queries, 4, metric, 0.2 if metric == "cosine" else None)
    assert sorted((r.query_id, r["rank"], r.similarity) for r in found.collect()) == sorted((r.query_id, r["rank"], round(r.score, 9)) for r in exact.collect())
    single = spark.sql("SELECT id, label, rank FROM match_test(array(0.0D, 2.0D, 1.0D), NULL, 2, NULL)").collect()
    assert [r["rank"] for r in sorted(single, key=lambda r: r["rank"])] == [1, 2]


def test_of_each_query_and_block_only_the_best_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(table_functions, "BLOCK", 16)
    units = spark.range(200).selectExpr("id % 190 AS id", "array(CAST(id % 7 AS FLOAT), CAST(id % 5 AS FLOAT)) AS embedding", "id AS place")
    units.createOrReplaceTempView("block_units")
    table_functions.register_match(spark, "match_blocks", "block_units", "ip")
    found = spark.sql("SELECT q.place AS asked, m.id, m.similarity, m.rank FROM (SELECT * FROM block_units WHERE place < 9) q, LATERAL match_blocks(CAST(q.embedding AS ARRAY<DOUBLE>), NULL, 4, q.id) m").collect()
    rows = [(n % 190, [n % 7, n % 5]) for n in range(200)]
    for n in range(9):
        scores = sorted((-float(v[0] * (n % 7) + v[1] * (n % 5)), i) for i, v in rows if i != n)[:4]
        assert sorted((r["rank"], r.id, r.similarity) for r in found if r.asked == n) == [(k, i, -s + 0.0) for k, (s, i) in enumerate(scores, 1)]
    assert spark.table("match_blocks_blocks").count() == 12


def total(one, two):
    return functools.reduce(lambda s, x: s + x, (a * b for a, b in zip(one, two, strict=True)), 0.0)


def test_calls_carry_numbers_of_blocks_and_no_vectors_of_the_table(spark, monkeypatch):
    """Blocks are read by the workers; rows in several slices and steps, equal vectors, nulls and several columns give what all pairs give."""
    monkeypatch.setattr(table_functions, "BLOCK", 100)
    rng = np.random.default_rng(3)
    rows = [(n if n else None, (rng.integers(-3, 4, 5) / 7.0).tolist() if n % 9 else [0.1, 0.2, 0.3, 0.4, 0.5], f"t{n % 3}" if n % 4 else None) for n in range(700)] + [(900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0], "x")]
    units = spark.createDataFrame(rows, "id int, embedding array<double>, label string").repartition(3)
    units.createOrReplaceTempView("sliced_units")
    table_functions.register_match(spark, "match_sliced", "sliced_units")
    assert spark.table("match_sliced_blocks").columns == ["block"] and spark.table("match_sliced_blocks").count() == 7
    found = spark.sql("SELECT q.id AS asked, m.id, m.label, m.similarity, m.rank FROM (SELECT * FROM sliced_units WHERE id % 50 = 1) q, LATERAL match_sliced(q.embedding, 0.3D, 12, q.id) m").collect()
    whole = [(i, v, label) for i, v, label in rows if v and None not in v and any(v)]
    for asked, query, _ in rows:
        if asked is not None and asked % 50 == 1 and query and any(query) and asked < 900:
            scored = [(total(v, query) / (math.sqrt(total(v, v)) * math.sqrt(total(query, query))), i, label) for i, v, label in whole if i != asked]
            best = sorted((-s, -1 if i is None else i, label or "") for s, i, label in scored if s > 0.3)[:12]
            got = sorted((r["rank"], -1 if r.id is None else r.id, r.label or "", r.similarity) for r in found if r.asked == asked)
            assert [(r, i, label) for r, i, label, _ in got] == [(n, i, label) for n, (_, i, label) in enumerate(best, 1)]
            assert [s for *_, s in got] == [-s for s, _, _ in best]

import random

import pytest

from casemill.operators import greedy
from casemill.plans import retrieval_queries


def shingles(core):
    return {core[i : i + 100] for i in range(0, max(0, len(core) - 100) + 1, 30) if len(core[i : i + 100]) >= 80}


def in_turn(hits, most):
    """(query, rank) of what the rule accepts, one hit after the other."""
    out = []
    for query in {q for q, _, _ in hits}:
        cores, seen = [], set()
        for rank, core in sorted((r, c) for q, r, c in hits if q == query and c):
            heads = [(min(greedy.HEAD, len(core), len(other)), other) for other in cores]
            if len(cores) == most or core in cores or seen & shingles(core) or any(n >= greedy.LEAST and core[:n] == other[:n] for n, other in heads):
                continue
            cores.append(core)
            seen |= shingles(core)
            out.append((query, rank))
    return sorted(out, key=repr)


def random_hits(seed, n):
    """Cores that share beginnings and passages, some cut off, most of them in one query."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.choice([30, 60, 90, 120]))) for _ in range(14)]
    hits = []
    for rank in range(n):
        core = "".join(rng.choice(passages) for _ in range(rng.choice([1, 1, 2, 3])))
        core = core[: rng.choice([20, 85, 100, 125, 131, 450, 450])]
        hits.append((rng.choice(["hot", "hot", "hot", None, "b", f"q{rank % 7}"]), rank * 3 + 1, rng.choice([core, core, core, "", None])))
    return hits


@pytest.mark.parametrize(("seed", "most", "first"), [(1, 5, 8), (2, 100, 64), (3, 10, 1)])
def test_rounds_equal_the_rule_in_turn(spark, monkeypatch, seed, most, first):
    monkeypatch.setattr(greedy, "FIRST", first)
    hits = random_hits(seed, 260)
    frame = spark.createDataFrame([(*h, "x") for h in hits], "query_id string, rank long, core string, q string").repartition(3)
    found = greedy.keep_distinct_hits(frame, most, candidate_limit=None)
    assert found.columns == frame.columns
    assert sorted(((r.query_id, r["rank"]) for r in found.collect()), key=repr) == in_turn(hits, most)


def test_a_chain_is_decided_from_its_beginning_and_an_empty_table_is_empty(spark):
    rng = random.Random(4)
    links = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(8)]
    hits = [("q", n, links[n] + links[n + 1]) for n in range(7)]  # each shares a passage with the next
    frame = spark.createDataFrame([(q, r, c) for q, r, c in hits], "query_id string, rank int, core string")
    got = [r["rank"] for r in greedy.keep_distinct_hits(frame).orderBy("rank").collect()]
    assert got == [r for _, r in in_turn(hits, 10)] and 3 < len(got) < 7
    assert greedy.keep_distinct_hits(frame.where("false")).count() == 0


def test_greedy_dedup_reads_a_source_to_its_end(spark, tmp_path):
    copy = "the same long text again and again in this one source of the collection " * 3
    rows = [(n, "hot", copy + f" tail number {n}") for n in range(700)]
    rows += [(1000 + n, "hot", chr(97 + n) * 40 + f" other text {n}") for n in range(4)] + [(2000, None, "a text without source"), (2001, None, "another")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = retrieval_queries.greedy_dedup(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == [0, 1000, 1001, 1002, 1003, 2000, 2001]

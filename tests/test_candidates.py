"""Candidates of a block of queries are merged as they come, and a query's k-th score bars what is worse."""

import numpy as np
import pyarrow as pa

from casemill.operators.retrieval import MERGE_ROWS, _Best


def test_candidates_are_merged_by_block_of_queries():
    rng = np.random.default_rng(3)
    whole = pa.schema([("query_id", pa.string()), ("id", pa.int64()), ("score", pa.float64())])
    ids = pa.array([f"q{n}" for n in range(40)])
    best, seen = _Best(5, whole, ids), []
    for start in range(0, 400_000, 20_000):
        which, score = rng.integers(0, 40, 20_000), rng.integers(0, 9_000, 20_000).astype(float)
        rows = np.arange(start, start + 20_000)
        best.add((which, pa.table({"query_id": ids.take(pa.array(which)), "id": rows, "score": score})))
        assert best.rows <= MERGE_ROWS and best.best.num_rows <= 200
        seen += zip(which, -score, rows, strict=True)
    assert (best.floor > -np.inf).all()
    got = [(r["query_id"], r["score"], r["id"]) for r in best.hits().to_pylist()]
    want = [(f"q{q}", -s, i) for q in range(40) for _, s, i in sorted(x for x in seen if x[0] == q)[:5]]
    assert got == want

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemill.llm import exact_dedup
from casemill.llm.exact_dedup import dedup_exact, rice_decode, rice_encode, rice_shift


@pytest.mark.parametrize("n", [0, 1, 2, 500])
@pytest.mark.parametrize("span", [10, 1 << 20, 1 << 60])
def test_golomb_code_round_trip(n, span):
    values = np.sort(np.random.default_rng(n).integers(0, span, n).astype(np.uint64))
    gaps = np.diff(values, prepend=np.uint64(0))
    shift = rice_shift(span, n)
    assert (rice_decode(rice_encode(gaps, shift), n, shift) == gaps).all()


def test_groups_match_a_dictionary(spark):
    texts = ["", None, "a", "A", "a ", "b" * 3000, "é", "é"] * 3 + [f"text {n % 37}" for n in range(200)]
    rows = [(n if n % 60 != 59 else None, t, 1) for n, t in enumerate(texts)] + [(5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(3)
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[text or ""].append(key)
    expected = []
    for key, text, _ in rows:
        members = groups[text or ""]
        keep = max((m for m in members if m is not None), default=None)
        expected.append((key, keep, len(members), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in dedup_exact(docs, owners=5).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    folded = dedup_exact(docs, normalise=F.lower(F.trim("text"))).where("text_sha256 = sha2('a', 256)")
    assert {r.group_size for r in folded.collect()} == {9}
    assert dedup_exact(docs.limit(0)).count() == 0


def test_different_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)))
    monkeypatch.setattr(exact_dedup, "_hash", lambda text: F.xxhash64(text) % 11)
    texts = [f"text {n % 40}" for n in range(90)] + [None, ""]
    groups = defaultdict(list)
    for n, text in enumerate(texts):
        groups[text or ""].append(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup_exact(docs, owners=3).collect()}
    assert got == {n: (max(groups[t or ""]), len(groups[t or ""]), n == max(groups[t or ""])) for n, t in enumerate(texts)}


def test_blocks_of_few_rows_meet_at_their_owners(spark, monkeypatch):
    values = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 2000)
    values[500:700] = values[:200]
    for owners in (1, 7):
        parts = [pd.DataFrame([{"block": b, **m} for m in exact_dedup.sealed(block, owners)]) for b, block in enumerate(np.array_split(values, 9))]
        sent = pd.concat(parts)
        replies = pd.concat([exact_dedup._reply(rows) for _, rows in sent.groupby("owner")])
        assert sum(np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: r.n].sum() for r in replies.itertuples()) == 400
        assert sum(map(len, sent["coded"])) < 8.5 * len(values)

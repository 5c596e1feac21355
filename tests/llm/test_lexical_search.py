import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from casemill.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    """All products, one by one."""
    read = [(key, Counter(terms(text))) for key, text in docs]
    read = [(key, counts, sum(counts.values())) for key, counts in read if counts]
    n_docs, length = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, counts, _ in read for t in counts)
    asked = {}
    for key, text in items:
        asked.setdefault(key, Counter()).update(terms(text))
    out = []
    for key, counts in asked.items():
        scored = []
        for doc, held, n in read:
            m = 25 + (75 * n * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 8 * m)) for t, times in counts.items() if t in held)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(key, rank, doc, -minus) for rank, (minus, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "É", "é", "漢字", "x1", "a_b", "don't", "\x7f", "straße", "ÀB"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_search_equals_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical_search, "CHUNK", 50 if block == 3 else 1 << 21)
    docs = [(n, text) for n, text in enumerate(texts(1, 150))]
    docs += [(n + 200, text) for n, text in docs[:40]] + [(7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (500, None), (501, ""), (502, " .,;\n"), (503, "the " * 30000 + "w1")]
    items = [(n, text) for n, text in enumerate(texts(2, 20))] + [(3, "w1 w2 the"), (None, "the w5 w5"), (60, None), (61, ""), (62, "unheardof"), (63, "THE the É é")]
    found = lexical_search.search(
        spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, score string, rank int").repartition(3),
        spark.createDataFrame([(a, b, "y") for a, b in items], "item_id long, text string, doc_id string").repartition(2), k=7,
    )
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(docs, items, 7)


def test_empty_tables_give_no_rows(spark):
    docs, items = (spark.createDataFrame([(1, "one")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(docs, items).count() == 1


def test_a_filter_full_of_collisions_loses_nothing(spark, monkeypatch):
    docs = [(n, text) for n, text in enumerate(texts(3, 60))]
    items = [(0, "the w1 w2 w3"), (1, "straße 漢字")]
    monkeypatch.setattr(lexical_search, "term_filter", lambda named: np.full(4096, 255, np.uint8))
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(docs, items, 10)

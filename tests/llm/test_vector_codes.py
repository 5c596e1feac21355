import hashlib
import math
import random

import numpy as np
import pytest

from casemill.llm import vector_codes


def by_hand(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error, digest) in plain integers."""
    kept = [(key, [math.floor(256 * x) for x in v], label) for key, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[list(cut[n][p]) for n in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), at) for at, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for vector in cut:
                groups.setdefault(nearest(vector[p], books[p])[1], []).append(vector[p])
            for at, members in groups.items():
                books[p][at] = [sum(m[i] for m in members) // len(members) for i in range(width)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(key, "".join(f"{at:02x}" for _, at in f), error, totals[label], digest) for (key, _, label), f, error in zip(kept, found, errors, strict=True)]


def frame(spark, rows, tasks=5):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(tasks)


def vectors(n, seed=1, dim=32, scale=1.0):
    rng = random.Random(seed)
    return [(i * 3 % n, [rng.gauss(0, scale) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "scale"), [(300, 1.0), (40, 1.0), (90, 900.0)])
def test_codes_equal_plain_integers(spark, monkeypatch, n, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    monkeypatch.setattr(vector_codes, "CHUNK", 16)
    rows = vectors(n, scale=scale)
    rows += [(rows[0][0], rows[0][1], 2), (500, None, 1), (501, [float("nan"), *rows[0][1][1:]], 1), (502, [None, *rows[0][1][1:]], 1), (503, [float("-inf"), *rows[0][1][1:]], None), (504, [], 1), (None, rows[5][1], None)]
    found = vector_codes.encode(frame(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(by_hand(rows), key=repr)


def test_equal_vectors_leave_later_entries_unused(spark):
    rows = [(n, [0.5] * 16, 1) for n in range(80)] + [(100 + n, [-0.25] * 16, 2) for n in range(5)]
    assert sorted(tuple(r) for r in vector_codes.encode(frame(spark, rows)).collect()) == sorted(by_hand(rows))


def test_what_cannot_be_coded_is_refused_and_an_empty_table_is_empty(spark):
    rows = vectors(10)
    assert vector_codes.encode(frame(spark, rows).where("false")).count() == 0
    assert vector_codes.encode(frame(spark, [(1, None, 1)])).count() == 0
    for odd in ([0.0] * 16, [1e9] * 32):
        with pytest.raises(ValueError):
            vector_codes.encode(frame(spark, [*rows, (99, odd, 1)]))


def test_distances_beyond_32_bits_are_exact():
    values = np.array([[1 << 25, -(1 << 25)], [3, 5]])
    picks, least = vector_codes.nearest(values, np.array([[0, 0], [1 << 25, 4]]))
    assert picks.tolist() == [1, 0] and least.tolist() == [1, (1 << 50) + 25]

from collections import Counter, defaultdict

import pytest

from casemill.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), share=150, cap=2) -> dict:
    """Share by weight, cut at the cap and share the excess again until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget = sum(sizes.values()) * share / 100
    full, targets = set(), {}
    while True:
        free = [s for s in names if s not in full]
        rest = budget - sum(cap * sizes[s] for s in full)
        targets = {s: float(cap * sizes[s]) for s in full}
        if not free:
            return targets
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > cap * sizes[s]]
        if not over:
            return targets | {s: unit * weight[s] for s in free}
        full.update(over)


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, __copies string, note string")


def make(spark):
    data = []
    for n in range(400):
        source = [None, "a", "b", "é", "Z", "b"][n % 6] if n % 3 else "hot"
        data.append((n if n % 50 else None, "w " * (n % 17), source, "x", "kept"))
    data += [(7, None, "nulls", "x", "n"), (7, "", "nulls", "x", "n"), (8, "one two", "b", "x", "n"), (8, "one two", "b", "x", "n")]
    return data


def test_targets_match_repeated_sharing(spark):
    data = make(spark)
    sizes = defaultdict(int)
    for _, text, source, *_ in data:
        sizes[source] += len((text or "").split())
    frame = rows(spark, data).drop("__copies")
    found = {r.source: (r["__source_size"], r["__target"]) for r in mixing.mixed(frame).select("source", "__source_size", "__target").distinct().collect()}
    expected = brute_targets(sizes)
    assert {s: v[0] for s, v in found.items()} == dict(sizes)
    for source, (_, target) in found.items():
        assert target == pytest.approx(expected[source], rel=1e-9, abs=1e-9)
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_copies_are_bounded_rerunnable_and_near_the_target(spark):
    frame = rows(spark, make(spark)).drop("__copies")
    first, again = mixing.mixed(frame).collect(), mixing.mixed(frame.repartition(7)).collect()
    assert Counter(map(str, first)) == Counter(map(str, again))
    taken, target = defaultdict(int), {}
    for r in first:
        assert 0 <= r["__copies"] <= 2
        taken[r.source] += r["__copies"] * r["__size"]
        target[r.source] = r["__target"]
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)


def test_emitted_repeats_rows_and_keeps_columns(spark):
    frame = rows(spark, make(spark)).drop("__copies")
    chosen = mixing.mixed(frame)
    expected = Counter()
    for r in chosen.collect():
        expected[(r.doc_id, r.text, r.source, r.note)] += r["__copies"]
    out = mixing.emitted(chosen)
    assert out.columns == frame.columns
    assert Counter((r.doc_id, r.text, r.source, r.note) for r in out.collect()) == +expected


def test_empty_table(spark):
    assert mixing.mixed(rows(spark, []).drop("__copies")).count() == 0


def test_clashing_columns_and_rows_without_an_id(spark):
    rows = [(None, f"word {n} " * 5, "a", 1, "x", "y") for n in range(400)] + [(n, "one two", "b", 1, "x", "y") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __source string, __target string")
    out = mixing.mixed(docs).collect()
    assert len(out) == 460 and {r["__size"] for r in out} == {10, 2}
    taken = sum(r["__size"] * r["__copies"] for r in out if r.source == "a")
    target = next(r["__target"] for r in out if r.source == "a")
    assert abs(taken - target) < 0.1 * target  # rows without an id draw by their text, not all alike

import random

import pytest

from casemill.functions import text as tx
from casemill.operators import cases, containment, relational
from pyspark.sql import functions as F

STARTS = ["the", "in", "in re", "the", "a", "smith &", "reg"]


def names(seed, n):
    """Names that begin with the same few words and share many of them, some cut off, with citations and endings."""
    rng = random.Random(seed)
    words = ["of", "the", "case", "v", "co", "norris", "o'brian", "attorney", "general", "ltd", "kent", "é", "and", "&"]
    made = []
    for _ in range(n):
        name = " ".join([rng.choice(STARTS), *(rng.choice(words) for _ in range(rng.randint(0, 7)))])
        name += rng.choice(["", "", " [1999] AC 1", ".xml", "  "])
        made.append(rng.choice([name, name.upper(), name[: rng.randint(3, 30)]]))
    return [*made, "", None, "v", "  ", "[1999] X"]


@pytest.mark.parametrize("dealt", [2, 2000])
def test_pairs_equal_the_nested_loop(spark, monkeypatch, dealt):
    monkeypatch.setattr(containment, "DEALT", dealt)
    rng = random.Random(5)
    hays = [" ".join(rng.choice(["the", "cat", "on", "a", "mat", "dé"]) for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, "", "the"]
    needles = [h[i : i + n] for h in hays if h for i, n in [(rng.randint(0, 5), rng.randint(1, 14))]] + ["", None, "zzz", "zzz the", "t", "the cat on the mat and on"]
    left = spark.createDataFrame([(rng.choice("xyz") if rng.random() < 0.9 else None, n) for n in needles], "by string, needle string")
    right = spark.createDataFrame([(rng.choice("xyz"), h) for h in hays], "by string, hay string")
    got = sorted(tuple(r) for r in containment.containing_pairs(left, right).collect())
    one, two = {tuple(r) for r in left.collect()}, {tuple(r) for r in right.collect()}
    assert got == sorted((by, n, h) for by, n in one for other, h in two if by == other and n and h is not None and n in h)
    formed = containment.candidates(left.drop("by"), right.drop("by")).count()
    assert formed < 0.5 * len({n for _, n in one}) * len({h for _, h in two})


def test_tables_without_rows_pair_with_nothing(spark):
    left, right = spark.createDataFrame([("a",)], "needle string"), spark.createDataFrame([("a",)], "hay string")
    assert containment.containing_pairs(left.where("false"), right).count() == 0
    assert containment.containing_pairs(left, right.where("false")).count() == 0


def normal(spark, values, change):
    return {v: n for v, n in spark.createDataFrame([(v,) for v in values], "v string").select("v", change(F.col("v"))).collect()}


def test_names_are_resolved_as_by_looking_at_every_file(spark):
    targets, files = sorted(set(names(1, 80)), key=repr), names(2, 150)
    target, file = normal(spark, targets, tx.case_name), normal(spark, files, tx.case_name)

    def tier(t, c):
        words = t.split(" ")
        if t == c:
            return 1
        if len(t) >= 8 and (c.startswith(t[:30]) or (len(c) >= 8 and t.startswith(c[:30]))):
            return 2
        if words[0] == c.split(" ")[0] and sum(w in c for w in words[:5]) >= 2:
            return 3
        return None

    expected = {}
    for t in targets:
        for rank, f in enumerate(files):
            if found := tier(target[t], file[f]):
                expected[t] = (f, found)
                break
    rows = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "name string, rank int")
    got = {r.target: (r.matched, r.tier) for r in relational.resolve_names(spark.createDataFrame([(t,) for t in targets], "target string"), rows).collect()}
    assert got == expected and {t for _, t in got.values()} == {1, 2, 3}


def test_pairs_of_one_case_equal_the_rule_on_all_pairs(spark):
    one, two = names(3, 70), names(4, 70)
    left, right = spark.createDataFrame([(n,) for n in one], "source string"), spark.createDataFrame([(n,) for n in two], "name string")
    got = sorted(tuple(r) for r in relational.same_case_pairs(left, right).collect())
    all_pairs = left.distinct().crossJoin(right.distinct()).where(tx.same_case(F.col("source"), F.col("name")))
    assert got == sorted(tuple(r) for r in all_pairs.collect()) and len(got) > 50


def test_documents_are_matched_as_by_looking_at_all(spark):
    one = [n for n in names(6, 60) if n] + ["the reported case of norris v attorney general in the supreme court of kent", "THE  reported case of Norris"]
    two = [n for n in names(7, 60) if n] + ["about the reported case of norris v attorney general in kent", "the reported case of norris v attorney general in the supreme court of kent and others"]
    left = spark.createDataFrame([(n,) for n in one], "name string")
    right = spark.createDataFrame([(d, n) for n, d in enumerate(two)], "document string, rank int")
    got = {r.name: r.document for r in cases.matched_documents(left, right).collect()}
    pairs = left.distinct().crossJoin(right).where(cases.same_document(tx.normalize(F.col("name")), tx.normalize(F.col("document"))))
    expected = {r.name: r.m.document for r in pairs.groupBy("name").agg(F.min(F.struct("rank", "document")).alias("m")).collect()}
    assert got == expected and len(got) > 5


def test_segments_cover_each_text_once(spark):
    rng = random.Random(8)
    texts = {n: "".join(rng.choice("ab é漢") for _ in range(rng.randint(1, 30))) for n in range(40)} | {50: "", 51: None, 52: "plain"}
    spans = [(rng.randrange(42), a, a + rng.randint(-1, 6)) for a in [rng.randint(-2, 30) for _ in range(120)]] + [(1, None, 3), (99, 0, 1), (2, 0, 100), (2, 0, 100)]
    found = cases.highlight_segments(spark.createDataFrame(list(texts.items()), "id int, text string"), spark.createDataFrame(spans, "id int, start int, stop int"), "id", "text").collect()
    got = {n: sorted((r.begin, r.end, r.lit, r.segment) for r in found if r.id == n) for n in texts}
    for n, text in texts.items():
        marked = [any(i == n and None not in (a, b) and max(a, 0) <= at < b for i, a, b in spans) for at in range(len(text or ""))]
        edges = [at for at in range(len(marked) + 1) if at in (0, len(marked)) or marked[at] != marked[at - 1]] if marked else []
        assert got[n] == [(a, b, marked[a], text[a:b]) for a, b in zip(edges, edges[1:], strict=False)], (n, text)


def test_needles_whose_end_no_hay_holds_form_no_grams(spark, monkeypatch):
    needles = spark.createDataFrame([(f"the case number {n} [1999]",) for n in range(50)] + [("number 7",), ("n",), ("7 ",)], "needle string")
    hays = spark.createDataFrame([(f"the case number {n} (uk)",) for n in range(50)], "hay string")
    rows, write = {}, containment.written

    def counting(frame, tag, path=None):
        made = write(frame, tag, path)
        rows[tag] = made.count()
        return made

    monkeypatch.setattr(containment, "written", counting)
    found = sorted((r.needle, r.hay) for r in containment.containing_pairs(needles, hays).collect())
    texts = [f"the case number {n} (uk)" for n in range(50)]
    assert found == sorted((needle, hay) for needle in ("number 7", "n", "7 ") for hay in texts if needle in hay)
    assert rows["needle-grams"] == 5  # three of "number 7", one of each other; those of the 50 aren't formed

import random

import pytest
from llm.helpers import jaccard_components, near_copies, shingle_set

from casemill.llm import ngram_join


def check(spark, texts, words, percent):
    rows = [(7 * n % 101 if n % 11 else None, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, sig string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in ngram_join.ngram_components(docs, words, percent).collect())))
    expected = jaccard_components(rows, words, percent)
    assert got == sorted(str((k, n, c)) for (k, _), (n, c) in zip(rows, expected, strict=True))


def test_components_match_all_pairs(spark):
    check(spark, near_copies(), 4, 85)


@pytest.mark.parametrize("counted", [0.0, 0.05, 1.0])
def test_components_for_any_counted_part_and_one_hub(spark, monkeypatch, counted):
    monkeypatch.setattr(ngram_join, "COUNTED", counted)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    check(spark, near_copies(seed=8), 3, 60)


def family(members=150, words=130, seed=4):
    """One large family of near copies, many of them close to the threshold on either side, beside a shared passage."""
    rng = random.Random(seed)
    base, texts = [f"w{n}" for n in range(words)], []
    for at in range(members):
        text = list(base)
        for place in rng.sample(range(words), rng.choice([0, 1, 2, 3, 4])):
            text[place] = f"own{at}x{place}" if rng.random() < 0.7 else f"other{place}"
        texts.append(" ".join(text))
    return texts + [" ".join(base[:60] + [f"tail{at}y{n}" for n in range(rng.choice([4, 9, 70]))]) for at in range(40)]


def test_large_family_matches_all_pairs(spark):
    check(spark, family(), 4, 85)


def test_links_match_all_pairs(spark):
    texts = [*family(60), *near_copies(seed=9), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links, members = ngram_join.ngram_links(docs, 4, 85)
    by_class = {}
    for row in members.collect():
        by_class.setdefault(row["class"] and bytes(row["class"]), []).append(row["doc_id"])
    sets = [shingle_set(t, 4) for t in texts]
    assert sorted(by_class.get(None, [])) == [n for n, s in enumerate(sets) if not s]
    assert all(len({frozenset(sets[n]) for n in ids}) == 1 for key, ids in by_class.items() if key)
    one = {key: ids[0] for key, ids in by_class.items() if key}
    found = sorted(tuple(sorted((one[bytes(r.a)], one[bytes(r.b)]))) for r in links.collect())
    firsts = sorted(one.values())
    expected = [
        (i, j) for at, i in enumerate(firsts) for j in firsts[at + 1 :]
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    assert found == sorted(expected)


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "other words here"), (2, "other words here"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()) == [(1, "a b c d e f g h"), (2, "other words here"), (4, None)]
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{n}" for n in range(60_000))
    rows = [(1, long, "a", "b", "c"), (2, long + " more", "a", "b", "c"), (3, long.replace("w5", "v5"), "a", "b", "c"), (4, "x" * 500_000, "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, __kept_id string, __text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, 4, 85).collect()}
    assert found[1] == (59_997, 1) and found[2] == (59_998, 1) and found[3][1] == 3 and found[4] == (1, 4)
    kept = ngram_join.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_links_of_a_family_without_a_middle_are_merged_before_the_rest_meets(spark, monkeypatch):
    places = 9  # a member for each choice of words at these places; it links with the 45 that differ in at most two, 11,520 links in all
    texts = []
    for choice in range(1 << places):
        text = [f"w{n}" for n in range(130)]
        for at in range(places):
            text[7 + 13 * at] = f"p{at}c{choice >> at & 1}"
        texts.append(" ".join(text))
    tried, verify = [], ngram_join._Verifier.__call__

    def counting(self, pairs):
        links = verify(self, pairs)
        tried.append(self.tried.count())
        return links

    monkeypatch.setattr(ngram_join._Verifier, "__call__", counting)
    check(spark, [*texts, *near_copies()], 4, 85)
    assert tried[-1] < 11_520 / 2

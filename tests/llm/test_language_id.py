import os

import numpy as np
import pytest

from casemill.llm import language_id
from casemill.llm.catalogue import op12_language_id

FOLDER = "/root/testdata/sf0.01"


def phrases(text: bytes, sample: bytes) -> int:
    """Longest pieces that the sample holds, from left to right; a symbol that it lacks is a phrase alone."""
    at = count = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += max(1, size)
        count += 1
    return count


def test_phrases_are_those_of_a_greedy_parse():
    rng = np.random.default_rng(7)
    for letters in (b"ab", b"abcd \xc3\xa9"):
        sample = bytes(rng.choice(list(letters), 400))
        texts = [bytes(rng.choice(list(letters + b"z"), int(n))) for n in rng.integers(1, 1300, 40)] + [b"z", b"zz", b"zazz", b"a"]
        made = language_id.Parser(sample)
        got = language_id.code_lengths(texts, {"x": sample})[:, 0] / made.bits
        cut = language_id.SEGMENT
        assert np.allclose(got, [sum(phrases(t[i : i + cut], sample) for i in range(0, len(t), cut)) for t in texts])


def test_automaton_accepts_exactly_the_substrings():
    sample = b"abcbcabcaab"
    moves = language_id.suffix_automaton(sample)
    assert len(moves) <= 2 * len(sample)

    def accepted(piece):
        state = 0
        for symbol in piece:
            if symbol not in moves[state]:
                return False
            state = moves[state][symbol]
        return True

    pieces = {bytes(p) for n in range(1, 5) for p in np.stack(np.meshgrid(*[list(b"abc")] * n), -1).reshape(-1, n).astype(np.uint8)}
    assert all(accepted(p) == (p in sample) for p in pieces)


def rows(spark):
    words = {"en": "the house stood on a hill and nobody knew why it was there ", "de": "das haus stand auf einem hügel und niemand wusste warum es dort war ", "ru": "дом стоял на холме и никто не знал почему он там был "}
    made = [(n, words[lang] * 3, lang, None) for n, lang in enumerate(list(words) * 12)]
    odd = [(100, None, "en", 1), (101, "", "de", 1), (102, " 12 ... 34\n", None, 1), (None, words["de"], None, 1), (103, words["ru"] * 3000, None, 1), (103, words["ru"] * 3000, None, 1), (104, "漢字かな", None, 1)]
    return spark.createDataFrame(made + odd, "doc_id long, text string, lang string, score int")


def test_edges_have_defined_results(spark):
    docs = rows(spark)
    samples = language_id.fit(docs)
    assert sorted(samples) == ["de", "en", "ru"]
    found = language_id.identify(docs, samples)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in found.collect()]
    assert all(lang == "und" and score == 0 for key, lang, score in got if key in (100, 101, 102))
    assert [lang for key, lang, _ in got if key is None] == ["de"]
    assert [lang for key, lang, _ in got if key == 103] == ["ru", "ru"]
    assert all(0 <= score <= 1 for _, _, score in got)
    assert [lang for key, lang, _ in got if key == 104][0] in samples


def test_held_out_rows_and_null_labels_teach_nothing(spark):
    docs = rows(spark)
    changed = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zzzz qqqq' ELSE text END AS text", "lang")
    assert language_id.fit(docs) == language_id.fit(changed)
    assert language_id.fit(docs.where("doc_id < 0")) == {}
    empty = language_id.identify(docs.where("false"), {})
    assert empty.count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    met = op12_language_id(spark, FOLDER).where("held_out AND lang_pred <> 'und'").join(docs, "doc_id")
    right, all_rows = met.where("lang = lang_pred").count(), met.count()
    assert all_rows > 150 and right >= 0.98 * all_rows

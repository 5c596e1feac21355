import random

import pytest
import sentencepiece

from casemill.llm.catalogue import tokenizer_path
from casemill.llm.token_count import PieceModel, TextCounter, count_tokens

HARD = ["", " ", "  ", "a ", " a", "a  b", "\n", " \n", "é€𝔸漢字", "▁x", "x▁▁ y", "<s> </s> <unk> <0x0A>", "a\0b", "\t\ttab", "x" * 5000, "\nfoo  ", "!" * 3000, "漢" * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("pieces"))


def test_counts_equal_the_library(library):
    counter = TextCounter(PieceModel(tokenizer_path("pieces")), entries=500)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab  \n▁thereinéß漢 .,") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in texts:
        assert counter.count(text) == len(library.encode(text)), text[:50]


def test_operator(spark, library):
    rows = [(i, t, 1) for i, t in enumerate([*HARD, None])] + [(None, "a b", 1), (1, "same", 1), (1, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = count_tokens(docs, tokenizer_path("pieces"), limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = sorted(str((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100)) for i, t, _ in rows)
    assert sorted(str(tuple(r)) for r in out.collect()) == expected
    assert count_tokens(docs.limit(0), tokenizer_path("pieces")).count() == 0

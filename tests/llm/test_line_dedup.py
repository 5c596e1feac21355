import random

import pytest
from llm.helpers import within_one_word

from casemill.llm.line_dedup import dedup_lines

BLANKS = " \t\r\x0b\x0c"


def corpus(rng, documents=80):
    words = ["a", "b", "ab", "é", "漢字", "x1", "", "word"]
    bases = [" ".join(rng.choice(words) for _ in range(n)).strip() + "x" for n in (1, 2, 3, 4, 5, 5, 6, 7, 9, 12, 40, 130, 700)]

    def changed(line):
        parts = line.split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, kind = rng.randrange(len(parts) + 1), rng.choice("isd")
            parts[at : at + (kind != "i")] = [rng.choice(["a", "new", "Ω"])] * (kind != "d")
        return " ".join(parts)

    return [(n or None, "\n".join(rng.choice(["", changed(rng.choice(bases)), f" {rng.choice(bases)}\t"]) for _ in range(rng.randint(0, 8)))) for n in range(documents)]


def expected_rows(docs, percent):
    positions = sorted(
        ((-1 if key is None else key, at), line.strip(BLANKS))
        for key, text in dict.fromkeys(docs) if text is not None
        for at, line in enumerate(text.split("\n")) if line.strip(BLANKS)
    )
    gone = {place for n, (place, line) in enumerate(positions) if any(line == other or within_one_word(line, other, percent) for _, other in positions[:n])}
    for key, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = [line for at, line in enumerate(lines) if (-1 if key is None else key, at) not in gone]
        yield (key, None if text is None else "\n".join(kept), "y", len(lines), len(lines) - len(kept))


@pytest.mark.parametrize(("percent", "seed"), [(80, 5), (67, 6), (100, 7)])
def test_lines_match_all_pairs(spark, percent, seed):
    docs = corpus(random.Random(seed))
    docs += [(500, None), (501, ""), (5, docs[5][1])]
    frame = spark.createDataFrame([(k, t, "y") for k, t in docs], "doc_id long, text string, line string")
    got = [tuple(r) for r in dedup_lines(frame, percent=percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected_rows(docs, percent)))
    assert dedup_lines(frame.limit(0), percent=percent).count() == 0


def test_a_family_of_lines_with_one_changing_word(spark):
    docs = [(n, f"page {n} of the long report {n % 7 or 'x'}\nshort {n}\nthe same line everywhere\nlast") for n in range(300)]
    frame = spark.createDataFrame([(k, t, "y") for k, t in docs], "doc_id long, text string, line string")
    got = [tuple(r) for r in dedup_lines(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected_rows(docs, 80)))


def test_clashing_columns(spark):
    names = ["doc_id", "text", "h1", "words", "key", "gone", "id", "place", "__lines", "__gone_id"]
    frame = spark.createDataFrame([(1, "a b c d e f", *"abcdefgh"), (2, "a b c d e g\nz", *"abcdefgh")], names)
    rows = dedup_lines(frame).collect()
    assert sorted((r.doc_id, r.text, r.h1, r["__gone_id"], r["__lines"], r["__removed"]) for r in rows) == [(1, "a b c d e f", "a", "h", 1, 0), (2, "z", "a", "h", 2, 1)]

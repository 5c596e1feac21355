"""Texts are dealt by id before they become words: no word is shuffled on its way to its offset."""

from casemill.operators.cases import word_offsets


def test_no_exchange_stands_above_the_words(spark, capsys):
    rows = spark.createDataFrame([(1, "a bc, d"), (2, None), (3, "")], "id int, text string")
    found = word_offsets(rows, "id", "text")
    capsys.readouterr()
    found.explain()
    above = capsys.readouterr().out.split("Generate")[0]
    assert "Window" in above and "Exchange" not in above
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a", 0, 1), (1, 1, "bc", 2, 4), (1, 2, "d", 6, 7)]

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from casemill.llm import toxicity
from casemill.llm.toxicity import Lexicon, fold, held_out


def test_folding_undoes_disguises():
    plain = fold("idiot loser")
    for disguised in ("IDIOT Loser", "1d10t l0ser", "іdіоt lоser", "i.d.i.o.t loser", "idiiiiot loooser"[:8] + " loser", "ìdïöt lóser", "idiot, (loser)!"):
        assert fold(disguised).strip() == plain, disguised
    assert fold("in 2024 we saw 10 cases").split()[1] == "2024"


def test_exceptions_and_length():
    lexicon = Lexicon({fold("trash") + " ": 4.0})
    assert lexicon.evidence("the trash can is full")[0] == 0
    assert lexicon.evidence("trash. the trash can")[0] == 4.0
    assert lexicon.score("trash " + "fine word " * 5) > lexicon.score("trash " + "fine word " * 5000)
    assert 0 <= lexicon.score("") < 0.3


def test_learned_on_rows_outside_the_held_out_quarter(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for n in range(600):
        toxic = n % 6 == 0
        words = [rng.choice(["ga", "bu", "zo", "ri", "me"]) + rng.choice(["ka", "lo", "mi"]) for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = "grumpfel" + rng.choice(["a", "e", "is"])
        rows.append((n, " ".join(words), "x"))
        labels.append((n, int(toxic if not held_out(n) else not toxic)))  # wrong labels must not be seen
    docs = spark.createDataFrame([*rows, (None, None, "x"), (9000, "", "x")], "doc_id long, text string, score string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([*labels, (9001, None)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    right = sum((out[n].predicted == 1) == (n % 6 == 0) for n in range(600))
    assert right > 585 and out[None].predicted == out[9000].predicted == 0
    assert all(r.held_out == held_out(k) and r.predicted == int(r.score >= 0.3) for k, r in out.items())
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out.values())
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    row = scored.agg(
        F.count_if(F.expr("predicted = 1 AND toxic = 1")).alias("tp"), F.count_if(F.expr("predicted = 1 AND toxic = 0")).alias("fp"), F.sum("toxic").alias("p")
    ).first()
    assert row.tp >= 0.9 * row.p and row.tp >= 0.9 * (row.tp + row.fp)


def naive_evidence(lexicon, text):
    """Word by word: the heaviest term of each word that no exception phrase covers."""
    words = fold(text).split()
    covered = set()
    for phrase in (p.split() for p in lexicon.exceptions):
        for at in range(len(words) - len(phrase) + 1):
            if words[at : at + len(phrase)] == phrase:
                covered.update(range(at, at + len(phrase)))
    weights = [
        max((w for t, w in lexicon.weights.items() if word == t[:-1] or (not t.endswith(" ") and word.startswith(t))), default=0.0)
        for at, word in enumerate(words) if at not in covered
    ]
    return sum(weights), max(weights, default=0.0), max(1, len(words))


def test_matching_and_excusing_equal_a_naive_matcher():
    rng = random.Random(5)
    lexicon = Lexicon(
        {"trash ": 4.0, "tra": 1.0, "ciown": 2.0, "can ": 1.5, "fis": 0.5},
        exceptions=("trash can", "can trash", "ciown fish", "circus ciown", "trash can fish"),
    )
    vocabulary = ["trash", "can", "clown", "fish", "circus", "tray", "x", "TRA5H", "canal", "fishes"]
    for _ in range(2000):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))
        assert lexicon.evidence(text) == pytest.approx(naive_evidence(lexicon, text)), text


def test_excusing_is_linear():
    lexicon = Lexicon({"trash ": 4.0})

    def seconds(n):
        begun = time.perf_counter()
        lexicon.evidence("trash can " * n)
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(64_000) < 40 * seconds(4000) + 0.2
    assert lexicon.evidence("trash can " * 20_000 + "trash")[0] == 4.0


def test_learned_exceptions_and_repeated_ids(spark):
    rng, rows, labels = random.Random(2), [], []
    for n in range(900):
        toxic = n % 5 == 0
        words = [rng.choice(["ga", "bu", "zo", "ri"]) + rng.choice(["ka", "lo", "mi"]) for _ in range(30)]
        if toxic:
            words[7] = "kötermist"
        elif n % 20 == 1:
            words[7:7] = ["kötermist", "abfuhr"]  # harmless in this company
        rows += [(n, " ".join(words))] * (30 if n % 97 == 0 else 1)
        labels += [(n, int(toxic))] * (2 if n % 50 == 0 else 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert fold("kötermist abfuhr") in lexicon.exceptions
    assert lexicon.score("galo kötermist buka") >= 0.3 > lexicon.score("galo kötermist abfuhr buka")
    assert lexicon.score("galo " * 200_000 + "kötermist") < lexicon.score("galo kötermist")
    ties = toxicity.score_toxicity(docs, lexicon).groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 1")
    assert ties.count() == 0


def test_labels_of_other_documents(spark):
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1000, "you idiot moron, you stupid clown"), (1001, None)], "doc_id long, text string")
    for given in (docs, docs.limit(0)):
        lexicon = toxicity.fit(given, labels)
        assert lexicon.score("") < 0.3
    assert [r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()] == [1, 0]

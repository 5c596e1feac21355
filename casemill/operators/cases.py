"""Operators over cases: neighbours of picks, repair of cut-off texts, names by shared words, token offsets, sinks' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.operators.containment import containing_pairs
from casemill.scratch import written

#: Names of at least LONG characters mean one document if one holds the other's first HEAD characters.
LONG, HEAD = 15, 40


def test_neighbours(units: DataFrame, doc: str, position: str, text_col: str, least: int = 50) -> DataFrame:
    """doc, pick, text, previous, following: beginning, middle and end of the paragraphs of more than ``least`` characters.

    The middle is paragraph n // 2. Of fewer than three the first is the beginning and the second the end. Neighbours are
    those of the first paragraph with the same text; where there is none they are empty.
    """
    kept = units.select(doc, position, tx.strip(F.col(text_col)).alias("text")).where(F.length("text") > least)
    order, whole = Window.partitionBy(doc).orderBy(position), Window.partitionBy(doc)
    placed = kept.withColumns({
        "p": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(whole),
        "previous": F.lag("text", 1, "").over(order), "following": F.lead("text", 1, "").over(order),
    })
    few = F.when(F.col("p") == 0, "beginning").otherwise("end")
    pick = F.when(F.col("n") < 3, few).when(F.col("p") == 0, "beginning").when(F.col("p") == F.floor(F.col("n") / 2), "middle").when(F.col("p") == F.col("n") - 1, "end")
    firsts = placed.groupBy(doc, "text").agg(F.min(F.struct("p", "previous", "following")).alias("first"))
    picked = placed.withColumn("pick", pick).where("pick IS NOT NULL").select(doc, "pick", "text")
    return picked.join(firsts, [doc, "text"]).select(doc, "pick", "text", "first.previous", "first.following")


def same_document(a: Column, b: Column) -> Column:
    """Whether two document names mean one document: equal when normalised, or both long and one holds the other's beginning."""
    long = (F.length(a) >= LONG) & (F.length(b) >= LONG)
    return (a != "") & (b != "") & ((a == b) | long & (F.contains(b, F.substring(a, 1, HEAD)) | F.contains(a, F.substring(b, 1, HEAD))))


def matched_documents(names: DataFrame, documents: DataFrame, name: str = "name", document: str = "document", rank: str = "rank") -> DataFrame:
    """name, document: for each name the first document (by ``rank``) that means the same.

    Equal names meet on the name. Of the others one holds the other's first 40 characters: they meet by the rarest gram of these,
    and each beginning takes the first document that it is found in, before names meet beginnings. Empty and null names
    match nothing.
    """
    left = written(names.select(name).distinct().withColumn("a", tx.normalize(F.col(name))).where("a <> ''"), "case-names")
    right = documents.select(tx.normalize(F.col(document)).alias("b"), F.struct(F.col(rank).alias("rank"), F.col(document).alias("document")).alias("m"))
    right = written(right.where("b <> ''").groupBy("b").agg(F.min("m").alias("m")), "case-documents")
    head = lambda c: F.substring(c, 1, HEAD)
    long_a, long_b = left.where(F.length("a") >= LONG), right.where(F.length("b") >= LONG)
    equal = left.join(right, F.col("a") == F.col("b")).select(name, "m")
    holders = containing_pairs(long_a.select(head("a").alias("needle")), long_b.select(F.col("b").alias("hay")))
    firsts = written(holders.join(right, F.col("hay") == F.col("b")).groupBy("needle").agg(F.min("m").alias("m")), "case-holders")
    held = long_a.join(firsts, head("a") == F.col("needle")).select(name, "m")
    begun = written(long_b.groupBy(head("b").alias("begun")).agg(F.min("m").alias("m")), "case-beginnings")
    holding = containing_pairs(begun.select(F.col("begun").alias("needle")), long_a.select(F.col("a").alias("hay")))
    around = holding.join(begun, F.col("needle") == F.col("begun")).join(left, F.col("hay") == F.col("a")).select(name, "m")
    both = equal.unionByName(held).unionByName(around)
    return both.groupBy(name).agg(F.min("m").alias("m")).select(name, F.col("m.document").alias(document))


def repaired_texts(cut: DataFrame, sentences: DataFrame, cell: str = "cell", document: str = "document", sentence: str = "sentence", position: str = "position") -> DataFrame:
    """cell, document, repaired: the sentence of the cell's document that begins with the cell, else holds it, else begins alike.

    ``cut`` has one row for each cell and its document. Earlier sentences come first; "begins alike" compares the first 80
    characters of the normalised texts. All sentences of a document are compared with its cells: they meet on the document.
    """
    alike = lambda c: F.substring(tx.normalize(c), 1, 80)  # noqa: E731  formed once a row, not once a pair
    asked = cut.select(cell, document).distinct().select(cell, document, tx.strip(F.col(cell)).alias("__c"), alike(tx.strip(F.col(cell))).alias("__asked"))
    held = sentences.select(document, sentence, position, alike(F.col(sentence)).alias("__held"))
    begins, holds = F.startswith(F.col(sentence), F.col("__c")), F.contains(F.col(sentence), F.col("__c"))
    starts = begins | holds & F.startswith(F.col(sentence), F.substring("__c", 1, 50))
    tier = F.when(starts, 1).when(holds, 2).when(F.startswith("__held", "__asked"), 3)
    met = asked.join(held, document).withColumn("tier", tier).where("tier IS NOT NULL")
    return met.groupBy(cell, document).agg(F.min(F.struct("tier", position, sentence)).alias("m")).select(cell, document, F.col(f"m.{sentence}").alias("repaired"), "m.tier")


def best_titles(queries: DataFrame, titles: DataFrame, query: str = "q", words: str = "words", title_id: str = "id", title: str = "title") -> DataFrame:
    """query, id, n: the title that holds most of a query's words (of equals the smallest id); queries without any have no row.

    Titles are reduced to distinct ones with their smallest id, words to distinct words; a word meets titles by its rarest
    gram, and queries then meet the titles that hold their words.
    """
    wanted = queries.select(query, F.explode(F.transform(words, lambda w: F.lower(w))).alias("w")).where("length(w) > 1").groupBy(query, "w").agg(F.count(F.lit(1)).alias("times"))
    low = written(titles.groupBy(F.lower(F.col(title)).alias("low")).agg(F.min(title_id).alias(title_id)), "titles")
    pairs = containing_pairs(wanted.select(F.col("w").alias("needle")), low.select(F.col("low").alias("hay")), 3)
    holders = written(pairs.join(low, F.col("hay") == F.col("low")).select(F.col("needle").alias("w"), title_id), "title-words")
    hits = wanted.join(holders, "w").groupBy(query, title_id).agg(F.sum("times").alias("n"))
    return hits.groupBy(query).agg(F.max_by(title_id, F.struct("n", -F.col(title_id))).alias(title_id), F.max("n").alias("n"))


def word_offsets(rows: DataFrame, id_cols: str | list[str], text_col: str) -> DataFrame:
    """id, nth, word, start, stop of the words of ASCII letters, digits and underscores; offsets count characters from 0.

    The ids (one column or several) tell rows apart; null and empty texts have no words.
    """
    ids = [id_cols] if isinstance(id_cols, str) else id_cols
    pattern = "[A-Za-z0-9_]+"
    # rows are dealt by id before they become words, so that texts travel and words don't; both arrays are formed once a row
    dealt = rows.select(*ids, text_col).repartition(*ids)
    listed = dealt.select(*ids, F.regexp_extract_all(text_col, F.lit(f"({pattern})"), 1).alias("__words"), F.split(text_col, pattern).alias("__gaps"))
    zipped = F.arrays_zip(F.col("__words").alias("word"), F.slice("__gaps", F.lit(1), F.size("__words")).alias("gap"))
    pieces = listed.select(*ids, F.posexplode(zipped).alias("nth", "piece"))
    stop = F.sum(F.length("piece.gap") + F.length("piece.word")).over(Window.partitionBy(*ids).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("stop", stop).select(*ids, "nth", "piece.word", (F.col("stop") - F.length("piece.word")).alias("start"), "stop")


def highlight_segments(texts: DataFrame, spans: DataFrame, id_col: str, text_col: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """id, begin, end, lit, segment: each text cut into alternating marked and plain segments that cover it once.

    Spans may overlap, touch, repeat or reach beyond the text; they are marked as one where they overlap or touch. A sweep counts the
    open spans at each place where one begins or ends, so the work grows with a text's spans. Spans without characters, null
    spans and spans of texts that are not there mark nothing; an empty or null text has no segments. Ids are distinct.
    """
    sized = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("n")).where("n > 0")
    clipped = spans.select(F.col(id_col).alias("id"), F.greatest(F.col(start), F.lit(0)).cast("int").alias("a"), F.col(stop).cast("int").alias("b")).join(sized.select("id", "n"), "id")
    clipped = clipped.select("id", "a", F.least("b", "n").alias("b")).where("a < b")
    edges = clipped.select("id", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("by")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("by")))).alias("e"))
    edges = edges.select("id", "e.at", "e.by").unionByName(sized.select("id", F.explode(F.array(F.lit(0), F.col("n"))).alias("at"), F.lit(0).alias("by")))
    places = edges.groupBy("id", "at").agg(F.sum("by").alias("by"))  # what happens at one place happens at once, so touching spans are one
    order = Window.partitionBy("id").orderBy("at")
    swept = places.select("id", "at", (F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias("lit"))
    turns = swept.withColumn("before", F.lag("lit").over(order)).join(sized.select("id", "n"), "id").where((F.col("before").isNull() | (F.col("before") != F.col("lit")) | (F.col("at") == F.col("n"))))
    ended = turns.withColumn("end", F.lead("at").over(order)).where("end IS NOT NULL")
    cut = ended.join(sized.select("id", "text"), "id")
    return cut.select(F.col("id").alias(id_col), F.col("at").alias("begin"), "end", "lit", F.substring(F.col("text"), F.col("at") + 1, F.col("end") - F.col("at")).alias("segment"))


def checked(rows: DataFrame, valid: Column, reason: str) -> DataFrame:
    """``rows`` with ``rejected``: null for rows that may be appended, the reason for those that go to quarantine."""
    return rows.withColumn("rejected", F.when(~F.coalesce(valid, F.lit(False)), F.lit(reason)))


def aligned_cells(values: DataFrame, marks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, place, value, mark: two grids cell by cell; the marks are null throughout where the grids' shapes differ."""
    one = values.unpivot(key, columns, "place", "value")
    two = marks.unpivot(key, [c for c in columns if c in marks.columns], "place", "mark")
    shapes = [frame.agg(F.count(F.lit(1)).alias(name)) for frame, name in ((one, "__one"), (two, "__two"))]
    equal = shapes[0].crossJoin(shapes[1]).select((F.col("__one") == F.col("__two")).alias("__equal"))  # single rows
    return one.join(two, [key, "place"], "left").crossJoin(equal).select(key, "place", "value", F.when(F.col("__equal"), F.col("mark")).alias("mark"))

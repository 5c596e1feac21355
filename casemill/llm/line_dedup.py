"""Near-duplicate lines by a deletion neighbourhood of words, in DataFrame functions only.

A line goes if an earlier line of the corpus equals it or lies within one word edit of it (a word replaced, added or
left out, whatever the word's length), where one edit may be at most 100 - ``percent`` percent of the longer line's
words: the bound is one edit from five words on at 80 percent, and none below. Earlier: by document id, then line
number. The relation is not chained: a line is judged against all earlier lines, also against those that go themselves.

1. Suspects. One edit leaves the first or the second half of the shorter line's words whole, so a line emits its two
   halves and the places where a shorter partner's halves may stand in it, as hashed keys; lines whose keys meet
   no other line have no near copy. This loses nothing and leaves few lines.
2. Neighbourhood. Each suspect emits every variant within the bound as a hashed key: the words before and behind each
   left-out word, and, for partners with one word more, those before and behind each gap. A key is the exclusive or of
   the words' hashes, salted by their places from the front or from the end, so a window yields all keys of a line in
   one pass. Lines that share a variant are within one edit of each other, so each is compared with the earliest of the
   variant alone; no pairs inside a family of near copies are made.
3. A line and the earliest line of each of its variants are verified on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import only_possible, remove, written

#: Words of two lines that must agree, in percent of the longer line's.
PERCENT = 80
#: A line is heavy if it is at least one in so many of all lines: at most so many lines are, and only they are broadcast.
HEAVY_SHARE = 1000
#: Tasks that share a heavy line's occurrences.
SALTS = 64
POSITION = ("id", "text_hash", "line_no")


#: What is taken off the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def _line_key(line: Column) -> Column:
    """What is compared: the line without blanks at its ends; few lines have any, and looking is cheaper than trimming."""
    ends = [line.startswith(b) | line.endswith(b) for b in BLANKS]
    return F.when(ends[0] | ends[1] | ends[2] | ends[3] | ends[4], F.btrim(line, F.lit(BLANKS))).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines: id, text_hash, line_no, line, h1, h2 (128 bits together)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    lines = source.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", _line_key(F.col("line"))).where(F.col("line") != "")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


def _position() -> Column:
    return F.struct(*POSITION)


def least_words(percent: int) -> int:
    """Words from which one edit is within the bound."""
    return -(-100 // (100 - percent))


def _halves(lines: DataFrame, percent: int) -> DataFrame:
    """Lines with enough words, one row for each key: bucket, h1, own (a half of the line itself).

    The first half has a word more where the words are odd. In a line with one word more, a partner's halves stand
    where the line's own do, but for one: its first half is a word shorter if the line's words are odd, its second
    half is if they are even.
    """
    words = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    counted = lines.select("line", "h1", words.alias("words")).where(F.col("words") >= least_words(percent) - 1)
    halves = (
        "xxhash64(0, substring_index(line, ' ', int((words + 1) div 2)))",
        "xxhash64(1, substring_index(line, ' ', -int(words div 2)))",
        "xxhash64(1 - words % 2, substring_index(line, ' ', if(words % 2 = 1, int(words div 2), 1 - int(words div 2))))",
    )
    keys = counted.select("h1", F.posexplode(F.array(*map(F.expr, halves))).alias("nth", "bucket"))
    return keys.select("bucket", "h1", (F.col("nth") < 2).alias("own"))


def _variants(suspects: DataFrame, percent: int) -> DataFrame:
    """The hashed variants of each distinct line: key, h1, h2."""
    words = suspects.select("h1", "h2", F.split("line", " ").alias("words"))
    words = words.select("h1", "h2", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    salted = words.withColumns({"front": F.xxhash64("word", "at"), "back": F.xxhash64("word", F.col("at") - F.col("n"))}).drop("word")
    line = Window.partitionBy("h1", "h2").orderBy("at")
    upto = F.bit_xor(F.col("front").bitwiseXOR(F.col("back"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.bit_xor("back").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = salted.withColumns({"upto": upto, "whole": whole})
    behind = F.col("upto").bitwiseXOR(F.col("whole"))  # the words up to here from the front, the others from the end
    without = F.xxhash64(behind.bitwiseXOR(F.col("front")), "at", "n")
    keys = F.array(
        F.when(F.col("n") >= least_words(percent), without),
        F.xxhash64(behind, F.col("at") + 1, F.col("n") + 1),
        F.when(F.col("at") == 0, F.xxhash64("whole", F.lit(0), F.col("n") + 1)),
    )
    return placed.select("h1", "h2", F.explode(F.array_compact(keys)).alias("key"))


def _within_one(line: str, other: str, percent: int) -> Column:
    """Whether two lines' words differ by one edit that the bound allows."""
    a, b = F.split(line, " "), F.split(other, " ")
    longer, apart = F.greatest(F.size(a), F.size(b)), F.abs(F.size(a) - F.size(b))

    def alike(x: Column, y: Column) -> Column:
        """Words at the beginning that agree; the shorter one's end agrees with nothing."""
        first = F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), False)
        return F.when(first == 0, longer).otherwise(first - 1)

    return (apart <= 1) & (longer >= least_words(percent)) & (alike(a, b) + alike(F.reverse(a), F.reverse(b)) >= longer - 1)


def _near_drops(lines: DataFrame, percent: int) -> DataFrame:
    """(h1, h2) of the lines within one edit of an earlier, different line."""
    spark = lines.sparkSession
    keys, keys_path = written(spark, _halves(lines, percent), "line-halves")
    shared = keys.groupBy("bucket").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own"))
    # written, so that Spark can split the join of a half that a large part of all lines has
    shared, shared_path = written(spark, shared.where("low <> high AND own").select("bucket"), "line-shared")
    wanted, wanted_path = written(spark, keys.join(shared, "bucket", "left_semi").select("h1").distinct(), "line-wanted")
    remove(spark, keys_path)
    remove(spark, shared_path)
    # of equal lines the first stands for all
    possible = only_possible(lines, F.col("h1"), wanted, wanted.count()).groupBy("h1", "h2").agg(F.min(_position()).alias("pos"), F.first("line").alias("line"))
    suspects, suspects_path = written(spark, possible.join(wanted, "h1", "left_semi"), "line-suspects")
    remove(spark, wanted_path)

    variants = _variants(suspects, percent)
    met = variants.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    met, met_path = written(spark, variants.join(met, "key", "left_semi").join(suspects.select("h1", "h2", "pos"), ["h1", "h2"]), "line-variants")
    firsts, firsts_path = written(spark, met.groupBy("key").agg(F.min(F.struct("pos", "h1", "h2")).alias("first")), "line-firsts")
    later = (F.col("h1") != F.col("first.h1")) | (F.col("h2") != F.col("first.h2"))
    pairs = met.join(firsts, "key").where(later).select("h1", "h2", F.col("first.h1").alias("other_h1"), F.col("first.h2").alias("other_h2")).distinct()
    first = suspects.select("h1", "h2", "line")
    second = suspects.select(F.col("h1").alias("other_h1"), F.col("h2").alias("other_h2"), F.col("line").alias("other_line"))
    verified = pairs.join(first, ["h1", "h2"]).join(second, ["other_h1", "other_h2"]).where(_within_one("line", "other_line", percent))
    drops, _ = written(spark, verified.select("h1", "h2").distinct(), "near-lines")
    for path in (suspects_path, met_path, firsts_path):
        remove(spark, path)
    return drops


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document with dropped lines: id, text_hash and the sorted numbers (from 0) of the lines that go."""
    spark = docs.sparkSession
    lines = _lines(docs, id_col, text_col)
    occurrences = lines.select(*POSITION, "h1", "h2")
    marked = occurrences.groupBy("h1", "h2").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("n"))
    if percent < 100:
        near = _near_drops(lines, percent)
        marked = marked.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    else:
        marked = marked.withColumn("near", F.lit(None).cast("boolean"))
    marked, _ = written(spark, marked.where("n > 1 OR near"), "line-marks")
    # a heavy line's occurrences are dealt to SALTS tasks
    least = F.lit((marked.agg(F.sum("n")).first()[0] or 0) / HEAVY_SHARE)
    marked = marked.withColumn("heavy", F.col("n") >= least)
    heavy = F.broadcast(marked.where("heavy").select("h1", "h2", "heavy"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("id", "line_no"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = only_possible(occurrences, F.col("h1"), marked.select("h1"), marked.count()).join(heavy, ["h1", "h2"], "left").select(*POSITION, "h1", "h2", salt.alias("salt"))
    gone = dealt.join(marked.select("h1", "h2", "first", "near", F.explode(salts).alias("salt")), ["h1", "h2", "salt"])
    gone = gone.where(F.col("near") | (_position() != F.col("first")))
    # rows that repeat a whole (id, text) stand at one position and keep or lose a line together
    return gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the text cleaned, and __lines, __removed (long): how many lines there were and went.

    Lines end at newlines; blank lines stay; lines are compared without blanks at their ends; their words lie between
    single blanks, so a text without blanks is one word. ``percent`` sets from how many words on one edit is within the
    bound (100: lines go only when equal to an earlier one). Null texts stay null and empty texts empty,
    with 0 removed; a null id comes before all others; rows that repeat an id with the same text are treated
    alike, with other texts by a hash of the text; a document whose lines all go has the empty text; an
    empty table gives no rows; other columns pass through, but for __lines and __removed, which are replaced.
    Equal lines are summed before they are shuffled; they are told apart by 128 bits of their hashes, rows of one id by 64.
    """
    gone = dropped_lines(docs, id_col, text_col, percent).withColumnsRenamed({"id": "__gone_id", "text_hash": "__gone_hash", "gone": "__gone_lines"})
    joined = docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs[text_col]) == gone["__gone_hash"]), "left")
    numbers = gone["__gone_lines"]
    parts = F.split(docs[text_col], "\n")
    cleaned = F.array_join(F.filter(parts, lambda line, at: ~F.array_contains(numbers, at)), "\n")
    others = [F.when(numbers.isNull(), docs[c]).otherwise(cleaned).alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("__lines", "__removed")]
    return joined.select(
        *others,
        F.coalesce(F.octet_length(docs[text_col]) - F.octet_length(F.replace(docs[text_col], F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("__lines"),
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("__removed"),
    )

"""Which texts hold which others: a join by the rarest gram.

Every short text (needle) meets only the texts (hays) that hold the gram of it that fewest hays hold. Frequencies are
counted first, over the grams that needles have; grams that many hays hold are dealt to several tasks. No needle meets a hay that
lacks its rarest gram, and a needle with a gram that no hay holds meets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.scratch import written

#: Characters of a gram, and hays of one gram that are met in one task.
GRAM, DEALT = 6, 2_000


def containing_pairs(needles: DataFrame, hays: DataFrame, gram: int = GRAM) -> DataFrame:
    """by, needle, hay: the distinct pairs in which the hay holds the needle and both have the same ``by``.

    ``needles`` has the columns needle and, if wanted, by (a text); ``hays`` hay and by. Empty and null needles, null hays and
    a null ``by`` meet nothing. Needles shorter than a gram are grams themselves. Repeated rows count once.
    """
    formed = candidates(needles, hays, gram)
    return formed.where(F.contains("hay", "needle"))


def candidates(needles: DataFrame, hays: DataFrame, gram: int = GRAM) -> DataFrame:
    """by, needle, hay: the pairs that meet on a needle's rarest gram, before they are compared."""
    n = written(_distinct(needles, "needle").where("needle <> ''").withColumn("needle_id", F.monotonically_increasing_id()), "needles")
    h = written(_distinct(hays, "hay").withColumn("hay_id", F.monotonically_increasing_id()), "hays")
    lengths = sorted(r[0] for r in n.select(F.least(F.length("needle"), F.lit(gram)).alias("n")).distinct().collect())  # at most ``gram`` numbers
    if not lengths:
        return n.crossJoin(h.drop("by")).select("by", "needle", "hay").where("false")
    every = F.flatten(F.array(*[grams(F.col("hay"), F.lit(size)) for size in lengths]))
    # a needle whose last gram no hay holds meets none: the others alone become grams
    ends = n.select("by", F.right("needle", F.lit(gram)).alias("gram")).distinct()
    known = written(h.select("by", F.explode(every).alias("gram")).join(ends, ["by", "gram"], "left_semi").distinct(), "known-ends")
    possible = n.withColumn("gram", F.right("needle", F.lit(gram))).join(known, ["by", "gram"], "left_semi")
    asked = written(possible.select("by", "needle_id", F.explode(grams(F.col("needle"), F.least(F.length("needle"), F.lit(gram)))).alias("gram")), "needle-grams")
    wanted = written(asked.select("by", "gram").distinct(), "wanted-grams")
    held = written(h.select("by", "hay_id", F.explode(every).alias("gram")).join(wanted, ["by", "gram"], "left_semi"), "hay-grams")
    counts = written(held.groupBy("by", "gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    chosen = asked.join(counts, ["by", "gram"], "left").groupBy("by", "needle_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    # heavy grams are dealt to several tasks: each needle goes to all of them, each hay to one
    shares = F.ceil(F.col("n") / DEALT).cast("int")
    sought = written(chosen.select("by", "needle_id", "gram", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")), "needle-keys")
    used = written(sought.groupBy("by", "gram").agg((F.max("share") + 1).alias("shares")), "used-grams")
    given = held.join(used, ["by", "gram"]).select("by", "gram", "hay_id", F.pmod(F.xxhash64("hay_id"), F.col("shares")).cast("int").alias("share"))
    met = written(sought.join(given, ["by", "gram", "share"]).select("needle_id", "hay_id"), "met-pairs")
    return met.join(n, "needle_id").join(h.drop("by"), "hay_id").select("by", "needle", "hay")


def grams(text: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` characters; none of a shorter text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, size)))


def _distinct(frame: DataFrame, column: str) -> DataFrame:
    by = F.col("by") if "by" in frame.columns else F.lit("")
    return frame.select(by.alias("by"), column).where(F.col("by").isNotNull() & F.col(column).isNotNull()).distinct()


def beginnings(text: Column, least: int, most: int) -> Column:
    """The first ``least`` to ``most`` characters of a text, as far as it has them."""
    sizes = F.when(F.length(text) >= least, F.sequence(F.lit(least), F.least(F.length(text), F.lit(most)))).otherwise(F.array().cast("array<int>"))
    return F.transform(sizes, lambda n: F.substring(text, F.lit(1), n))

"""Greedy suppression of near-duplicate hits in rank order, as rounds over a graph of conflicts.

Taken one by one, a hit is accepted if it conflicts with none that was accepted before. The same set comes out of rounds in
which many hits are judged at once: a hit is accepted when no undecided hit before it conflicts with it, and what
conflicts with an accepted one is refused. Hits conflict through keys they share, so that rounds are aggregates and joins by key and
no task ever holds the hits of a query. As a query wants few hits, its undecided ones behind the last wanted accepted one
are dropped after each round, and only its first hits are looked at until they prove too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.scratch import written

#: Characters of a core by which hits are compared from their beginning: all of them, but those of the shorter one if it has at least LEAST.
HEAD, LEAST = 130, 80
#: Hits of a query that are looked at first, about, and how many times as many next time.
FIRST, FURTHER = 64, 16


def keep_distinct_hits(hits: DataFrame, most: int = 10, query: str = "query_id", candidate_limit: int | None = 500, core: str = "core", rank: str = "rank") -> DataFrame:
    """The accepted hits of each query, at most ``most``, in rank order.

    A hit is refused if its core is null or empty, equals an accepted one, begins like one (the first 130 characters, or all of the
    shorter one if it has at least 80), or shares a shingle with one. ``rank`` is a whole number that no two hits of a
    query share, from whatever number on and with gaps. Only hits up to rank ``candidate_limit`` count (the search's own oversampling; None: all of
    them). A null query is a query; an empty table gives no rows.
    """
    usable = hits if candidate_limit is None else hits.where(F.col(rank) <= candidate_limit)
    named = usable.select(F.to_json(F.struct(query)).alias("q"), F.col(rank).cast("long").alias("rank"), F.col(core).alias("core"))
    # of equal cores the first alone can be accepted
    firsts = written(named.groupBy("q", "core").agg(F.min("rank").alias("rank")), "greedy-cores").where("core <> ''")  # tested when it is there: cores are dear
    spread = firsts.groupBy("q").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n"))
    # ranks may have gaps: so many of them hold FIRST hits
    queries = written(spread.select("q", "low", "high", ((F.col("high") - F.col("low") + 1) * FIRST / F.col("n")).alias("reach")), "greedy-queries")
    accepted, further = [], 1
    while True:
        end = F.col("low") + F.col("reach") * further
        part = firsts.join(queries, "q").where(F.col("rank") < end)
        chosen = written(_rounds(part.select("q", "rank", "core"), most), "greedy-chosen")
        done = chosen.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        left = written(queries.where(F.col("high") >= end).join(done, "q", "left_anti"), "greedy-open")
        accepted.append(chosen.join(left.select("q"), "q", "left_anti"))
        if left.isEmpty():
            break
        queries, further = left, further * FURTHER
    found = accepted[0]
    for more in accepted[1:]:
        found = found.unionByName(more)
    keyed = hits.withColumns({"__q": F.to_json(F.struct(query)), "__rank": F.col(rank).cast("long")})
    return keyed.join(written(found.withColumnsRenamed({"q": "__q", "rank": "__rank"}), "greedy-accepted"), ["__q", "__rank"], "left_semi").drop("__q", "__rank")


def _rounds(cores: DataFrame, most: int) -> DataFrame:
    """q, rank of the first ``most`` accepted of each query among ``cores`` (q, rank, core)."""
    keys = written(conflict_keys(cores), "greedy-keys")
    undecided = written(cores.select("q", "rank"), "greedy-hits")
    accepted: list[DataFrame] = []
    while True:
        if accepted:
            keys = written(keys.join(undecided, ["q", "rank"], "left_semi"), "greedy-keys")
        # the first holder of each key, and the first that holds it as its own beginning
        firsts = written(keys.groupBy("q", "key").agg(F.min("rank").alias("any"), F.min(F.when(F.col("own"), F.col("rank"))).alias("first_own"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "greedy-firsts")
        before = F.when(F.col("own"), F.col("any")).otherwise(F.col("first_own"))
        blocked = keys.join(firsts, ["q", "key"]).where(before < F.col("rank")).select("q", "rank").distinct()
        fresh = written(undecided.join(blocked, ["q", "rank"], "left_anti"), "greedy-fresh")
        accepted.append(fresh)
        # keys of the accepted: whoever holds one beside them, with one of the two as its own, is refused
        taken = keys.join(fresh, ["q", "rank"], "left_semi").groupBy("q", "key").agg(F.max("own").alias("taken_own"))
        refused = keys.join(taken, ["q", "key"]).where(F.col("own") | F.col("taken_own")).select("q", "rank").distinct()
        so_far = accepted[0]
        for more in accepted[1:]:
            so_far = so_far.unionByName(more)
        last = _first(so_far, most).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")).where(F.col("n") >= most).drop("n")
        rest = undecided.join(fresh, ["q", "rank"], "left_anti").join(refused, ["q", "rank"], "left_anti").join(last, "q", "left").where("last IS NULL OR rank < last")
        undecided = written(rest.select("q", "rank"), "greedy-hits")
        if undecided.isEmpty():
            return _first(so_far, most)


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each query; Spark limits the groups before it shuffles them."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("n") <= most).drop("n")


def conflict_keys(cores: DataFrame) -> DataFrame:
    """q, rank, key, own: two hits of a query conflict if they share a key that is the own one of either.

    Shingles and beginnings of HEAD characters are own keys of all that hold them. A core of LEAST to HEAD characters
    is its own key too, and the beginning of that length is a key of every core that is longer; these are formed only for cores that
    share their first LEAST characters with such a short one.
    """
    digest = lambda kind, text: F.md5(F.concat(F.lit(kind), text))
    length = F.length("core")
    shingles = cores.select("q", "rank", F.explode(F.array_distinct(F.transform(tx.shingles(F.col("core")), lambda s: digest("s", s)))).alias("key"), F.lit(True).alias("own"))
    heads = cores.where(length >= LEAST).select("q", "rank", digest("h", F.substring("core", 1, HEAD)).alias("key"), F.lit(True).alias("own"))
    start = digest("b", F.substring("core", 1, LEAST)).alias("start")
    short = written(cores.where((length >= LEAST) & (length < HEAD)).select("q", start, length.alias("n")).distinct(), "greedy-short")
    begins: Column = digest("h", F.substring(F.col("core"), F.lit(1), F.col("n")))
    longer = cores.where(length > LEAST).select("q", "rank", "core", start).join(short, ["q", "start"]).where(F.col("n") < length)
    return shingles.unionByName(heads).unionByName(longer.select("q", "rank", begins.alias("key"), F.lit(False).alias("own")))

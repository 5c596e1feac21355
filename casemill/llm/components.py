"""Connected components of an edge table by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import remove, written


def _once(edges: DataFrame) -> DataFrame:
    """Each edge in one direction and once."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is one node of its component.

    In each round every node points to its neighbour of the highest degree (ties by a hash that changes with
    the round) if that stands above itself, pointers are followed one step further, and edges are rewritten to
    the nodes pointed to, until none is left. Stars take one round; a path of n nodes takes about log n. Each
    round's tables are written to the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession
    current, current_path = written(
        spark, _once(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges"
    )
    labels: DataFrame | None = None
    labels_path, turn = "", 0
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        ranked = both.join(degree.select(F.col("a").alias("b"), "d"), "b")
        best = ranked.groupBy("a").agg(
            F.max(F.struct("d", F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("to"), F.count(F.lit(1)).alias("own")
        )
        above = (F.col("to.d") > F.col("own")) | (
            (F.col("to.d") == F.col("own")) & (F.col("to.h") > F.xxhash64("a", F.lit(turn)))
        ) | ((F.col("to.d") == F.col("own")) & (F.col("to.h") == F.xxhash64("a", F.lit(turn))) & (F.col("to.b") > F.col("a")))
        parent = best.select("a", F.when(above, F.col("to.b")).otherwise(F.col("a")).alias("p"))
        step = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = parent.join(step, "p").select("a", F.col("q").alias("p"))
        parent, parent_path = written(spark, parent, "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = parent.select(F.col("a").alias("root"), "p")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        before, (labels, labels_path) = labels_path, written(spark, labels, "labels")
        first = parent.select("a", F.col("p").alias("x"))
        second = parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        current = current.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        read, (current, current_path) = current_path, written(spark, _once(current), "edges")
        for path in filter(None, (before, parent_path, read)):
            remove(spark, path)
        turn += 1
    if labels is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    remove(spark, current_path)
    return labels

"""Mixing sources to target weights by repetition rates, in DataFrame functions only.

Tokens are summed per source, each source's target gives a repetition rate (target over size), and every
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import WORD, text_of

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
DRAWS = 1 << 32


def word_count(text: Column) -> Column:
    """Words of a text that may not be null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame,
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its target.

    Sources in code-point order, null last, take the weights in turn and share ``share_percent`` of all
    sizes. A target stops at ``most_repeats`` times its source's size and the excess goes to the others by
    weight until none is above: the level at which sum(min(cap, level * weight)) meets the budget, found
    from running sums over the sources in the order in which they fill up. Where every source is full the
    targets are the caps. The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    ring = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.select(
        source_col,
        "source_size",
        F.element_at(ring, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)).cast("long").alias("weight"),
        (F.col("source_size") * most_repeats).alias("cap"),
        (F.sum("source_size").over(Window.partitionBy()) * share_percent / F.lit(100.0)).alias("budget"),
    )
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(source_col).asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"))
        / F.sum("weight").over(onward).cast("double"),
    )
    # the first source in filling order that does not fill up sets the level; those after it would give lower ones
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    leveled = levels.withColumn("open_level", open_level)
    return leveled.select(
        source_col,
        "source_size",
        F.when(F.col("open_level").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")))
        .alias("target"),
    )


def draw(seed: int, *identity: Column) -> Column:
    """A number in [0, 1) from 32 bits of the md5 of the seed and the identity columns; nulls count as empty."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in identity)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / DRAWS


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies, one row per document.

    Null texts have size 0, null sources are one source, rows with a null id draw by their text, repeated rows draw
    alike and are each kept; a source of size 0 has rate 0; empty tables give no rows; other columns pass through, but
    for the four that are added, __source and __draw, which are replaced or dropped.
    Sizes are summed before the shuffle, so a source with a third of the rows costs no more than another;
    the table of sources is joined back by whichever strategy its measured size allows.
    """
    sized = docs.drop("__source", "__source_size", "__target", "__copies").withColumn("__size", word_count(text_of(text_col)))
    # drawn before the join, so that the text needn't travel with its row
    identity = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text|"), F.md5(text_of(text_col))))
    sized = sized.withColumn("__draw", draw(seed, identity))
    sizes = sized.groupBy(F.col(source_col).alias("__source")).agg(F.sum("__size").alias("source_size"))
    targets = source_targets(sizes, "__source", weights, share_percent, most_repeats).withColumnsRenamed(
        {"source_size": "__source_size", "target": "__target"}
    )
    joined = sized.join(targets, sized[source_col].eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (F.col("__draw") < rate - whole).cast("long")
    return joined.withColumn("__copies", copies).drop("__draw")


def emitted(chosen: DataFrame) -> DataFrame:
    """The mix itself: every row of :func:`mixed` as often as __copies says, without the working columns."""
    repeated = chosen.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.drop("__size", "__source_size", "__target", "__copies", "__copy")

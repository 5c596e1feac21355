"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context and that reply alone
trainable. Turns after the last assistant turn, and conversations without one, yield one more example
that has context only, so that every turn can be read back from the output.

Template, one turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles and texts a
backslash is doubled and every ``<`` and ``[`` is followed by a backslash, so neither the template's marks
nor other common control strings (``</s>``, ``[INST]``) can occur; a role's newlines become ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _swap(column: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escaped(text: Column) -> Column:
    """``text`` without any control string; :func:`unescaped` restores it."""
    return _swap(text, ("\\", "\\\\"), ("<", "<\\"), ("[", "[\\"))


def unescaped(text: Column) -> Column:
    return _swap(text, ("[\\", "["), ("<\\", "<"), ("\\\\", "\\"))


def escaped_role(role: Column) -> Column:
    """As :func:`escaped`, and ``~`` marks newlines: a role ends at the first newline of its turn."""
    return _swap(escaped(role), ("~", "~0"), ("\n", "~1"))


def unescaped_role(role: Column) -> Column:
    return unescaped(_swap(role, ("~1", "\n"), ("~0", "~")))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Examples: conv id, example long (from 0), last boolean, formatted string, loss_start long, loss_length long.

    The trainable span is the half-open range of code points from loss_start; a context-only example has
    null there. Null roles and texts are empty; a null conversation id is a conversation of its own; turns
    are ordered by turn (null first), then role, then text, and repeated rows are kept; empty tables give
    no rows; other columns are ignored. One shuffle on the conversation; each example is a row of its own,
    as long as the method's context demands.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    heads = F.transform("__turns", lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n")))
    bodies = F.transform("__turns", lambda t: escaped(t["text"]))
    replies = F.filter(
        F.transform("__turns", lambda t, at: F.when(t["role"] == TRAINED_ROLE, at)), lambda at: at.isNotNull()
    )
    size = F.size("__turns")
    # the last target is followed by a context-only one where turns remain
    targets = F.when(
        F.element_at(F.col("__turns"), -1)["role"] == TRAINED_ROLE, replies
    ).otherwise(F.concat(replies, F.array(size)))
    shaped = grouped.select(
        conv_col, size.alias("__size"), heads.alias("__heads"), bodies.alias("__bodies"), targets.alias("__targets")
    )
    shaped = shaped.withColumn(
        "__whole", F.zip_with("__heads", "__bodies", lambda head, body: F.concat(head, body, F.lit(CLOSE)))
    )
    cut = shaped.select("*", F.posexplode("__targets").alias("__example", "__at"))
    context = F.array_join(F.slice("__whole", F.lit(1), F.col("__at")), "")
    is_reply = F.col("__at") < F.col("__size")
    head, body = F.get("__heads", F.col("__at")), F.get("__bodies", F.col("__at"))
    cut = cut.select(
        conv_col,
        F.col("__example").cast("long").alias("example"),
        (F.col("__at") >= F.col("__size") - 1).alias("last"),
        F.when(is_reply, F.concat(context, head)).otherwise(context).alias("__before"),
        F.when(is_reply, body).alias("__reply"),
    )
    return cut.select(
        conv_col,
        "example",
        "last",
        F.concat("__before", F.coalesce(F.concat("__reply", F.lit(CLOSE)), F.lit(""))).alias("formatted"),
        F.when(F.col("__reply").isNotNull(), F.length("__before").cast("long")).alias("loss_start"),
        F.length("__reply").cast("long").alias("loss_length"),
    )


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text) structs read back from one example."""
    marked = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(part: Column) -> Column:
        body = F.substring_index(part, CLOSE, 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescaped_role(role).alias("role"),
            unescaped(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"),
        )

    return F.transform(marked, turn)


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The reply under the loss mask, unescaped; null for a context-only example."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def chat_digests(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from :func:`format_chats`: turns, their digest, trained text and sizes."""
    read = examples.select(
        conv_col,
        "example",
        F.when(F.col("last"), parsed_turns(F.col("formatted"))).alias("__turns"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("__reply"),
        F.length("formatted").cast("long").alias("__chars"),
    )
    joined = F.array_join(
        F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = read.select(
        conv_col, "example", "__reply", "__chars",
        F.size("__turns").alias("__n"), F.sha2(joined, 256).alias("__digest"),
    )
    totals = read.groupBy(conv_col).agg(
        F.max(F.when(F.col("__digest").isNotNull(), F.col("__n"))).cast("long").alias("n_turns"),
        F.max("__digest").alias("turns_sha256"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("__reply").isNotNull(), F.struct("example", "__reply")))),
                lambda r: r["__reply"],
            ),
            "",
        ).alias("__loss"),
        F.sum("__chars").alias("formatted_chars"),
    )
    return totals.select(
        conv_col, "n_turns", "turns_sha256",
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
its text alone is trainable. Turns after the last assistant turn, or all turns of a
conversation without one, form one more example with nothing trainable, so that the
examples hold every turn.

A user turn reads `[INST] text [/INST]`, an assistant turn `<a> text </s>`, any other turn
`<<role>> text <</>>`. In texts and roles `&`, `<`, `>` and `[` are written as entities, so a
control string can only be a mark, and entities are turned back in the reverse order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pairs, in the order of escaping.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;")]
USER, USER_END = "[INST] ", " [/INST]"
ANSWER, ANSWER_END = "<a> ", " </s>"
TURN_PATTERN = r"\[INST\] [^<\[]* \[/INST\]|<a> [^<\[]* </s>|<<[^<\[>]*>> [^<\[]* <</>>"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def formatted_turn(role: Column, text: Column) -> Column:
    """The marked and escaped form of a turn; null roles and texts count as empty."""
    role, body = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")))
    return (
        F.when(role == "user", F.concat(F.lit(USER), body, F.lit(USER_END)))
        .when(role == "assistant", F.concat(F.lit(ANSWER), body, F.lit(ANSWER_END)))
        .otherwise(F.concat(F.lit("<<"), escape(role), F.lit(">> "), body, F.lit(" <</>>")))
    )


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """`conv_id`, `example` (position of its last turn), `n_turns`, `whole`, `formatted`,
    `loss_start`, `loss_end`.

    `whole` marks the one example that holds all turns of its conversation. The loss mask is the code points from `loss_start` to `loss_end` of `formatted`; it is
    empty for an example without target. Turns follow their number, ties and missing
    numbers by role and text; repeated rows are turns of their own. Rows without
    conversation id form one conversation. An empty table gives no examples. Other columns
    are not read. A conversation is one row here, as its last example is one string; what
    grows with the square of a conversation's turns is the examples asked for.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        formatted_turn(F.col(role_col), F.col(text_col)).alias("form"),
    )
    grouped = turns.select(F.col(conv_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns")
    )
    placed = grouped.select(
        "conv_id", F.transform("turns", lambda t: t["form"]).alias("forms"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("answers"),
    ).withColumn("last", F.size("forms") - 1)
    each = placed.select(
        "conv_id", "forms", "answers", "last",
        F.explode(F.filter(
            F.sequence(F.lit(0), F.col("last")), lambda i: F.get("answers", i) | (i == F.col("last"))
        )).alias("example"),
    )
    made = each.select(
        "conv_id", "example", (F.col("example") + 1).cast("long").alias("n_turns"),
        (F.col("example") == F.col("last")).alias("whole"),
        F.array_join(F.slice("forms", F.lit(1), F.col("example") + 1), "").alias("formatted"),
        F.get("answers", F.col("example")).alias("trains"),
        F.length(F.get("forms", F.col("example"))).cast("long").alias("target"),
    )
    end = F.length("formatted").cast("long")
    return made.select(
        "conv_id", "example", "n_turns", "whole", "formatted",
        F.when(F.col("trains"), end - F.col("target") + len(ANSWER)).otherwise(end).alias("loss_start"),
        F.when(F.col("trains"), end - len(ANSWER_END)).otherwise(end).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, read back as an array of (role, text)."""

    def parse(turn: Column) -> Column:
        other_role = F.substring_index(F.substring(turn, F.lit(3), F.length(turn)), ">> ", 1)
        inner = F.length(other_role) + 5
        role = (
            F.when(turn.startswith(USER), F.lit("user")).when(turn.startswith(ANSWER), F.lit("assistant"))
            .otherwise(unescape(other_role))
        )
        before = F.when(turn.startswith(USER), len(USER)).when(turn.startswith(ANSWER), len(ANSWER)).otherwise(inner)
        after = (
            F.when(turn.startswith(USER), len(USER_END)).when(turn.startswith(ANSWER), len(ANSWER_END))
            .otherwise(len(" <</>>"))
        )
        body = F.substring(turn, before + 1, F.length(turn) - before - after)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN_PATTERN), F.lit(0)), parse)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, what reading its examples back gives: counts and hashes of turns and trained texts."""
    trained = unescape(F.expr("substring(formatted, cast(loss_start AS INT) + 1, cast(loss_end - loss_start AS INT))"))
    line = F.transform(
        read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    parts = made.select(
        "conv_id", F.struct("example", trained.alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"), F.when(F.col("whole"), F.col("formatted")).alias("whole"),
    )
    # Examples still lie where their conversation was gathered, so this moves nothing.
    read = parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("trained"),
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("formatted"),
    ).withColumn("lines", line)
    return read.select(
        "conv_id", F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )

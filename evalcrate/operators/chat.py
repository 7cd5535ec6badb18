"""Conversation operators on the long form ``(conv_id, turn, role, text)``
(W2/H3 pair_turns, W3 merge_adjacent_roles, H1 build_request, H2 append_history,
H4 set_system_prompt) and on message arrays.

Turn pairing is an equi-join on ``(conv_id, turn) = (conv_id, turn - 1)``
rather than ``lead()`` over a per-conversation window: the join hashes on
both columns, so one giant conversation still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.operators.positions import segmented_running_sum
from evalcrate.operators.prompts import msg

MSG_ARRAY = "array<struct<role:string,content:string>>"


def dense_turns(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", from_zero: bool = False) -> DataFrame:
    """``conv``, failing when a conversation's turn numbers have a gap or repeat (or do not start at 0).

    The check is a scalar subquery over one row of counts per conversation (partial sums)."""
    spans = conv.groupBy(conv_col).agg(F.count(F.lit(1)).alias("n"), F.min(turn_col).alias("a"), F.max(turn_col).alias("b"))
    bad = (F.col("b") - F.col("a") + 1) != F.col("n")
    if from_zero:
        bad = bad | (F.col("a") != 0)
    wrong = spans.agg(F.count_if(bad).alias("wrong")).scalar()
    say = F.raise_error(F.lit(f"{turn_col} must number each conversation without gaps" + (" from 0" if from_zero else "")))
    return conv.where(F.when(wrong > 0, say.cast("boolean")).otherwise(F.lit(True)))


def pair_turns(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
               even_only: bool = True) -> DataFrame:
    """(turn i, turn i+1) pairs; with ``even_only`` only pairs starting at even
    turns (history[0::2] zipped with history[1::2]: an odd tail is dropped).

    Requires dense 0-based turns, the contract of the conversation table; a gap fails."""
    conv = dense_turns(conv, conv_col, turn_col, from_zero=even_only)
    a = conv.alias("a")
    b = conv.alias("b")
    j = a.join(b, (F.col(f"a.{conv_col}") == F.col(f"b.{conv_col}")) &
               (F.col(f"b.{turn_col}") == F.col(f"a.{turn_col}") + 1))
    if even_only:
        j = j.where(F.col(f"a.{turn_col}") % 2 == 0)
    return j.select(F.col(f"a.{conv_col}").alias(conv_col), F.col(f"a.{turn_col}").alias(turn_col),
                    F.col("a.role").alias("role"), F.col("a.text").alias("text"),
                    F.col("b.role").alias("next_role"), F.col("b.text").alias("next_text"))


def merge_adjacent_roles_long(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """W3 (long form): gaps-and-islands — a new island starts where the role
    changes; texts of one island are concatenated in turn order.

    Island starts are found with the skew-safe neighbour join; the island
    number is a blocked running count of starts (no window group holds a
    whole conversation), and each island's texts are joined in turn order: one row
    holds one island, which is the result asked for.  A gap in the turns fails."""
    conv = dense_turns(conv, conv_col, turn_col)
    prev = conv.select(F.col(conv_col).alias("_c"), (F.col(turn_col) + 1).alias("_t"), F.col(role_col).alias("_prev"))
    flagged = conv.join(prev, (conv[conv_col] == prev["_c"]) & (conv[turn_col] == prev["_t"]), "left")
    start = (flagged["_prev"].isNull() | (flagged["_prev"] != flagged[role_col])).cast("int")
    base = flagged.select(conv[conv_col], conv[turn_col], conv[role_col], conv[text_col], start.alias("_start"))
    isl = segmented_running_sum(base, conv_col, turn_col, "_start", "_island")
    out = isl.groupBy(conv_col, "_island").agg(
        F.min(turn_col).alias(turn_col), F.first(role_col).alias(role_col),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(turn_col, text_col))),
                                 lambda x: x[text_col]), "").alias(text_col))
    return out.select(conv_col, (F.col("_island") - 1).alias("turn"), role_col, text_col)


def build_request(system_text, history, user_text) -> Column:
    """H1: ``[system] + history + [user]`` as a message array column."""
    sys_part = F.array(msg("system", system_text if isinstance(system_text, Column) else F.lit(system_text)))
    hist = history if history is not None else F.array().cast(MSG_ARRAY)
    return F.concat(sys_part, hist, F.array(msg("user", user_text)))


def append_history(conv: DataFrame, new_turns: DataFrame, conv_col: str = "conv_id",
                   turn_col: str = "turn", order_col: str | None = None) -> DataFrame:
    """H2: append (user, assistant) turns after each conversation's last turn.

    ``new_turns`` is ``(conv_id, user_text, assistant_text)``; the last turn per
    conversation is a partial/final aggregate, then two rows per exchange are
    unioned onto the long table.  Several exchanges of one conversation are
    numbered by ``order_col``; without it a second exchange fails."""
    nth = F.row_number().over(Window.partitionBy(conv_col).orderBy(order_col or conv_col))
    new_turns = new_turns.withColumn("_nth", nth)
    if order_col is None:
        say = F.raise_error(F.lit(f"several exchanges for one {conv_col} need an order_col"))
        new_turns = new_turns.where(F.when(F.col("_nth") > 1, say.cast("boolean")).otherwise(F.lit(True)))
    last = conv.groupBy(conv_col).agg(F.max(turn_col).alias("_last"))
    j = new_turns.join(last, conv_col, "left").withColumn(
        "_last", F.coalesce("_last", F.lit(-1)) + 2 * (F.col("_nth") - 1))
    add = j.select(conv_col, F.explode(F.array(
        F.struct((F.col("_last") + 1).alias(turn_col), F.lit("user").alias("role"), F.col("user_text").alias("text")),
        F.struct((F.col("_last") + 2).alias(turn_col), F.lit("assistant").alias("role"),
                 F.col("assistant_text").alias("text")))).alias("x")).select(conv_col, "x.*")
    return conv.select(conv_col, turn_col, "role", "text").unionByName(add)


def set_system_prompt(conv: DataFrame, system_text: str, conv_col: str = "conv_id",
                      turn_col: str = "turn") -> DataFrame:
    """H4: drop existing system messages and put a new one first (turn -1)."""
    kept = conv.where(F.col("role") != "system").select(conv_col, turn_col, "role", "text")
    heads = conv.select(conv_col).distinct().select(
        conv_col, F.lit(-1).cast(conv.schema[turn_col].dataType).alias(turn_col),
        F.lit("system").alias("role"), F.lit(system_text).alias("text"))
    return kept.unionByName(heads)


def to_long(df: DataFrame, id_col: str, messages_col: str = "messages") -> DataFrame:
    """Message array -> ``(id, pos, role, content)`` rows (for export / comparison)."""
    return df.select(id_col, F.posexplode(messages_col).alias("pos", "m")).select(
        id_col, "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))

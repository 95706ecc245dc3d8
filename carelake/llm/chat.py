"""Chat formatting: multi-party perspective rotation (operator 5).  DataFrame
functions only.

Every participant of a conversation gets a rendering in which their turns are
the assistant's, all other turns come from named users, and the loss mask holds
exactly the assistant's words with their closing marker.  System turns stay
system turns in every rendering and take no perspective.

A rendering is given in parts of ``PART_TURNS`` turn numbers, so a conversation
of any length spreads over many rows; parts in order make the whole dialogue.
The turns of a part are gathered once and meet the participants in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NAME_CHARS = r"[^\p{L}\p{N}_-]"


def _head(role: Column, perspective: Column) -> Column:
    name = F.regexp_replace(F.coalesce(role, F.lit("unknown")), NAME_CHARS, "_")
    who = (F.when(role == SYSTEM, F.lit("system")).when(role == perspective, F.lit("assistant"))
           .otherwise(F.concat(F.lit("user name="), name)))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per conversation, participant and part: ``perspective``, ``part``,
    ``messages`` (array of the part's turns), ``rendered`` and ``mask`` (array of
    begin and stop code points in ``rendered`` that are trained on).

    Turns are ordered by number, then role, then text; rows without a number come
    first, in part 0.  A null text is an empty turn; a turn without a role
    is spoken by the user "unknown", who takes no perspective; rows without a
    conversation form the conversation null.  Repeated rows are repeated turns.
    Markers inside texts are broken by a blank so that they stay text.  Other columns
    are not read.  Conversations of system turns alone and empty tables give no rows."""
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"))
    people = rows.where(F.col("role") != SYSTEM).select(F.col("conversation").alias("of"),
                                                        F.col("role").alias("perspective")).distinct()
    parts = rows.groupBy("conversation", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rotated = parts.join(people, F.col("conversation").eqNullSafe(F.col("of")))
    said = F.transform("turns", lambda m: F.struct(
        m["turn"].alias("turn"), F.coalesce(m["role"] == F.col("perspective"), F.lit(False)).alias("own"),
        _head(m["role"], F.col("perspective")).alias("head"), m["text"].alias("text")))
    rotated = rotated.withColumn("messages", said)
    shut = F.lit(CLOSE + "\n")
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["text"], shut)), "")
    spans = F.aggregate(
        "messages", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin: int, stop: int>>").alias("mask")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["head"]) + F.length(m["text"]) + len(CLOSE) + 1).alias("at"),
            F.when(m["own"], F.array_append(a["mask"], F.struct(
                (a["at"] + F.length(m["head"])).alias("begin"),
                (a["at"] + F.length(m["head"]) + F.length(m["text"]) + len(CLOSE)).alias("stop"))))
            .otherwise(a["mask"]).alias("mask")),
        lambda a: a["mask"])
    return rotated.select(F.col("conversation").alias(conversation), "perspective", "part", "messages",
                          rendered.alias("rendered"), spans.alias("mask"))


def chat_report(turns: DataFrame) -> DataFrame:
    """op5: one row per conversation, participant and part, the mask as begin:stop pairs."""
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["begin"].cast("string"),
                                                                  m["stop"].cast("string"))), ",")
    return rotate(turns).select("conv_id", "perspective", F.col("part").cast("bigint").alias("part"),
                                F.size("messages").cast("bigint").alias("n_turns"), F.size("mask").cast("bigint")
                                .alias("n_own"), "rendered", mask.alias("mask"))

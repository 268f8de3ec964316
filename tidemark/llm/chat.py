"""Chat formatting by perspective rotation.  Native.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant, all others as named users, system turns as
they are; the mask lists the character spans of the assistant's own words.

A conversation is rendered in pieces of ``piece`` turn numbers, so that the
longest one is spread over tasks: the pieces of a perspective, in order, are
its whole dialogue, and every piece carries its own offsets.  ``piece=None``
renders every conversation whole, in one row.

No text or role can pass for a marker: ``<|`` in them is written ``<\\|`` and
``<\\`` is written ``<\\\\`` (``unescape`` undoes both).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 32
SYSTEM = "system"
UNKNOWN = "unknown"


def escape(text: Column) -> Column:
    """The text without ``<|``, reversibly."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\\\"), F.lit("<\\"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", piece: int | None = PIECE) -> DataFrame:
    """One row per conversation, participant and piece.

    Columns: conv_id, assistant, piece, n_turns, text, n_chars, mask (spans ``start-end`` of the assistant's words in
    the piece's text, comma-joined), mask_chars.  Roles and texts are escaped; offsets are those of ``text`` as it is.

    Defined results: a null role speaks as ``unknown``; a null text is empty; turns are ordered by turn number,
    then role, then text; repeated rows are one turn; null turns make a last piece (piece is null); null
    conversation ids are one conversation.  A conversation of system turns only has no participant and no row.  Very
    long texts are rendered whole.  Other columns are left out, whatever their names.  Empty table: no rows.
    """
    t = conversations.select(
        F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"),
        escape(F.coalesce(F.col(role_col), F.lit(UNKNOWN))).alias("r"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).distinct()
    who = t.where(F.col("r") != SYSTEM).select(F.col("c").alias("wc"), F.col("r").alias("a")).distinct()
    turns = t.join(who, F.col("c").eqNullSafe(F.col("wc"))).drop("wc")
    own = F.col("r") == F.col("a")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("r") == SYSTEM, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user name="), F.col("r"), F.lit("|>\n")))
    number = F.lit(0) if piece is None else F.floor(F.col("t") / piece)
    said = turns.select("c", "a", number.cast("long").alias("p"), F.struct(
        "t", "r", "x", head.alias("h"), own.alias("o")).alias("s"))
    packed = said.groupBy("c", "a", "p").agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("m"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        begin = acc["at"] + F.length(s["h"])
        end = begin + F.length(s["x"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"),
                        F.when(s["o"], F.concat(acc["m"], F.array(span))).otherwise(acc["m"]).alias("m"),
                        F.when(s["o"], acc["n"] + F.length(s["x"])).otherwise(acc["n"]).cast("long").alias("n"))

    text = F.array_join(F.transform("s", lambda s: F.concat(s["h"], s["x"], F.lit("\n"))), "")
    folded = packed.select("c", "a", "p", F.size("s").cast("long").alias("k"), text.alias("text"),
                           F.aggregate("s", start, step).alias("f"))
    return folded.select(
        F.col("c").alias("conv_id"), F.col("a").alias("assistant"), F.col("p").alias("piece"), F.col("k").alias("n_turns"),
        "text", F.length("text").cast("long").alias("n_chars"), F.array_join("f.m", ",").alias("mask"),
        F.col("f.n").alias("mask_chars"))

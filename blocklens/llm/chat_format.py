r"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all preceding turns as
context, then that reply, which alone is trainable.  Turns after the last
assistant turn form one more example with an empty loss span, so the output
holds every turn of every conversation.

A turn is written ``### role: text</turn>\n``.  Inside texts and roles the
characters of the control strings are escaped with letters, ``\`` as ``\s``,
``<`` as ``\l`` and ``#`` as ``\h`` (and ``:`` as ``\c`` in roles), so an
escaped text never holds ``<`` or ``#`` and the marks can be split literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(MID))


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """``conv_id, example, n_turns, formatted, loss_start, loss_end, last``.

    One row per example; offsets count code points from 0, end exclusive.  Rows
    of a conversation go by ``turn`` (null first), then role and text; a null
    role or text counts as empty, a null conversation id is a conversation;
    repeated rows are turns each, and an empty table gives no examples.
    A conversation's turns meet in one row, since its context is their whole
    text; the examples leave that row one at a time.
    """
    part = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(part)).alias("_turns"))
    whole = whole.select("conv_id", F.size("_turns").alias("_n"), F.transform("_turns", lambda t: t.role == target).alias("_goal"), F.transform("_turns", lambda t: _head(t.role)).alias("_heads"), F.transform("_turns", lambda t: escape(t.text)).alias("_texts"))
    ends = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: F.get("_goal", i - 1) | (i == F.col("_n")))
    each = whole.select("*", F.posexplode(ends).alias("example", "_end"))
    before = F.array_join(F.transform(F.sequence(F.lit(1), F.col("_end")), lambda i: F.concat(F.get("_heads", i - 1), F.when(i < F.col("_end"), F.concat(F.get("_texts", i - 1), F.lit(CLOSE))).otherwise(F.lit("")))), "")
    goal = F.get("_texts", F.col("_end") - 1)
    each = each.select("conv_id", "example", F.col("_end").alias("n_turns"), before.alias("_before"), goal.alias("_text"), F.get("_goal", F.col("_end") - 1).alias("_trained"), (F.col("_end") == F.col("_n")).alias("last"))
    start = F.char_length("_before")
    return each.select(
        "conv_id", "example", "n_turns", F.concat("_before", "_text", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"), F.when(F.col("_trained"), start + F.char_length("_text")).otherwise(start).alias("loss_end"), "last",
    )


def parse_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a formatted example."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        at = F.locate(MID, piece)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(piece, at + len(MID), F.char_length(piece))).alias("text"),
        )

    return F.transform(pieces, one)


def chat_digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its formatted examples hold, read back from them.

    The turns are read from the last example; the digest of every earlier one
    must be that of the last one's beginning, or the query fails.
    """
    turns = parse_turns(F.col("formatted"))
    turn_text = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select(
        "conv_id", "example", F.char_length("formatted").cast("long").alias("_chars"), loss.alias("_loss"),
        F.when(F.col("last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(turn_text, 256).alias("sha"), F.col("formatted"))).alias("_whole"), F.md5("formatted").alias("_md5"),
    )
    each = F.struct("example", "_loss", "_chars", "_md5")
    found = read.groupBy("conv_id").agg(F.max("_whole").alias("_whole"), F.sum("_chars").alias("formatted_chars"), F.sort_array(F.collect_list(each)).alias("_losses"))
    same = F.forall("_losses", lambda x: F.md5(F.substring("_whole.formatted", F.lit(1), x["_chars"].cast("int"))) == x["_md5"])
    found = found.filter(F.when(same, True).otherwise(F.raise_error(F.lit("an example's context is not its conversation's beginning")).cast("boolean")))
    loss = F.array_join(F.transform("_losses", lambda x: x["_loss"]), "")
    return found.select("conv_id", F.col("_whole.n").alias("n_turns"), F.col("_whole.sha").alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

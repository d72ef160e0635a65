"""Chat formatting by event sourcing, with DataFrame functions only.

A log holds events of conversations: (conv_id, seq, message, kind, role, text). A message
opens with its first event; ``delta`` adds text, ``edit`` replaces the text so far, and
``regenerate`` replaces it too and withdraws the later messages of the conversation that
have no event after it. Events of a message are folded in the order of seq (a replacement
before a delta of the same seq, then by text). Messages are rendered in the order of their
number.

A turn is written as the opening mark, the role, a line feed, the text, the closing mark
and a line feed. Control strings of the common templates cannot occur inside: the first
character of one becomes ``~1`` or ``~2``, a tilde ``~0`` and a line feed in a role ``~3``.
The loss mask lists the byte spans of assistant texts in the output.

Nulls: a null kind is a delta, a null text is empty, the role is the largest one given and
empty if there is none, a null conversation or message number is one of its own, and a null
seq comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Control strings of chat templates in public use (fixed values):
#: <|im_start|> <|im_end|> <s> </s> <<SYS>> <</SYS>> [INST] [/INST]
ANGLE_CONTROL = r"<(?=\|im_(?:start|end)\|>|/?s>|</?SYS>>)"
SQUARE_CONTROL = r"\[(?=/?INST\])"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the role that is learned from."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    learned: str = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLE_CONTROL, "~1"), SQUARE_CONTROL, "~2")


def unescape(text: Column) -> Column:
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the messages that are left in the end."""
    kind = F.coalesce("kind", F.lit("delta"))
    resets = kind.isin("edit", "regenerate")
    event = F.struct(F.col("seq"), F.when(resets, 0).otherwise(1).alias("after"), F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(
        F.max("role").alias("role"), F.max("seq").alias("last"), F.max(F.when(kind == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max(F.when(resets, event)).alias("reset"), F.sort_array(F.collect_list(event)).alias("events"))
    valid = F.filter("events", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    text = F.array_join(F.transform(valid, lambda e: e.text), "")
    earlier = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    folded = messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), "last", "regenerated")
    withdrawn = F.coalesce(F.max("regenerated").over(earlier) > F.col("last"), F.lit(False))
    return folded.withColumn("withdrawn", withdrawn).where(~F.col("withdrawn")).select("conv_id", "message", "role", "text")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss: one text for each conversation and its loss mask.

    ``loss`` is an array of (start, size) in bytes, in order.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~3"))
    head = F.concat(F.lit(template.open), role, F.lit("\n"))
    turns = messages.select("conv_id", "message", (F.col("role") == template.learned).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(template.close + "\n")))
    until = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.octet_length("turn")).over(until) - F.octet_length("turn") + F.octet_length("head")
    placed = turns.select("conv_id", "message", "turn", "learned", start.alias("start"), F.octet_length("body").cast("bigint").alias("size"))
    in_order = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn", "learned", "start", "size"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), t.size.alias("size")))
    return in_order.select("conv_id", F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a rendered text."""
    tail = len(template.close) + 1

    def turn(part: Column) -> Column:
        size = F.char_length(F.substring_index(part, "\n", 1))
        role = F.left(part, size)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, size + 2, F.char_length(part) - size - 1 - tail)).alias("text"))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in template.open)
    return F.transform(F.filter(F.split(formatted, quoted), lambda p: F.char_length(p) > 0), turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one piece after the other."""
    raw = formatted.cast("binary")
    pieces = F.transform(loss, lambda s: unescape(F.substring(raw, (s.start + 1).cast("int"), s.size.cast("int")).cast("string")))
    return F.array_join(pieces, "")


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A log with one event for each row of a table (conv_id, turn, role, text).

    Rows of one turn are turns of their own, ordered by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("message"), "role", "text").select(
        "conv_id", F.col("message").cast("bigint").alias("seq"), F.col("message").cast("bigint").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss for every conversation of an event log; an empty log gives none."""
    return render(fold_events(events), template)

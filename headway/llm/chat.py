"""Chat formatting as relational expressions.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into messages
by array aggregation, and the messages are concatenated. A message is

    <|start|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

with one TEXT for each merged turn. Texts and roles are escaped: a backslash is doubled and ``<|`` becomes ``<\\|``,
so no text can hold a control string and the escape can be undone. The loss mask has the spans of the assistant's
texts in each message, as code points of the formatted message.

Turns are ordered by ``turn`` (nulls first), then role, then text; repeated rows stay. A null text or role is empty.
Rows with a null conversation id form one conversation. A conversation is one output row, so its turns meet in one
task. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _cut(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E", -1)


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one message: role and texts."""

    def step(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        added = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(
            last["role"] == turn["role"], F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), added)
        ).otherwise(F.array_append(done, fresh))

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)"), step)


def _spans(message: Column, loss_role: str) -> Column:
    head = F.length(F.concat(F.lit(START), escape(message["role"]), F.lit(TEXT)))
    empty = F.expr("cast(array() as array<struct<start: int, chars: int>>)")

    def step(seen: Column, text: Column) -> Column:
        span = F.struct(seen["at"].alias("start"), F.length(escape(text)).alias("chars"))
        return F.struct(
            (seen["at"] + F.length(escape(text)) + len(NEXT)).alias("at"), F.array_append(seen["spans"], span).alias("spans")
        )

    spans = F.aggregate(message["texts"], F.struct(head.alias("at"), empty.alias("spans")), step, lambda x: x["spans"])
    return F.when(message["role"] == loss_role, spans).otherwise(empty)


def format_chats(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = ASSISTANT,
) -> DataFrame:
    """Per conversation: ``conv_id``, the ``formatted`` text and ``loss_mask``, per message the spans to learn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(
        F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    messages = sorted_turns.select("conv_id", _merged(F.col("turns")).alias("messages"))
    body = lambda m: F.array_join(F.transform(m["texts"], escape), NEXT)
    written = lambda m: F.concat(F.lit(START), escape(m["role"]), F.lit(TEXT), body(m), F.lit(END))
    return messages.select(
        "conv_id",
        F.array_join(F.transform("messages", written), "").alias("formatted"),
        F.transform("messages", lambda m: _spans(m, loss_role)).alias("loss_mask"),
    )


def _messages(formatted: Column) -> Column:
    """The formatted messages without their end marks."""
    parts = _cut(formatted, END)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped, in order."""

    def turns(message: Column) -> Column:
        role = unescape(F.substring_index(F.substring(message, len(START) + 1, 2**31 - 1), TEXT, 1))
        rest = _cut(message, TEXT)[1]
        return F.transform(_cut(rest, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(_messages(formatted), turns))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    texts = F.zip_with(
        _messages(formatted), loss_mask,
        lambda m, spans: F.array_join(F.transform(spans, lambda s: unescape(F.substring(m, s["start"] + 1, s["chars"]))), ""),
    )
    return F.array_join(texts, "")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: counts and SHA-256 digests of turns and loss text."""
    read = formatted.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

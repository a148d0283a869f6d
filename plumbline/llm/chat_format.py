"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted; neighbours of one role become one block; the blocks are joined to one
text. Control strings all begin with ``<|``, and in roles and texts that pair is escaped (a backslash is doubled, and one
is put inside ``<|``), so reading back gives every turn, also those inside a merged block, letter by letter.

Defined results: null roles and texts are empty ones; turns are ordered by turn number, then role, then text, null
numbers first; repeated turns are kept; rows without a conversation id form one conversation; an empty table gives no
conversations. A conversation is one row of the result, so its turns have to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pii import running_totals

#: Control strings: a block's opening, the end of its role, a further turn in the block, the block's end.
TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: key, ``formatted``, and ``loss_spans``, the (start, length) of all texts under the loss mask.

    Starts are code points from 0 in ``formatted``, from running totals of the parts' lengths. A merged block of the loss
    role has one span per turn.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    chats = turns.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    follows = lambda i: (i > 0) & (F.get("turns", i - 1)["role"] == F.get("turns", i)["role"])

    def lead(t: Column, i: Column) -> Column:
        opened = F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(TURN), escaped(t.role), F.lit(SAYS))
        return F.when(follows(i), F.lit(NEXT)).otherwise(opened)

    def part(t: Column, i: Column) -> Column:
        return F.struct(lead(t, i).alias("lead"), escaped(t.text).alias("text"), (t.role == LOSS_ROLE).alias("counts"))

    made = chats.select("_key", F.transform("turns", part).alias("parts"))
    long = lambda p: (F.length(p.lead) + F.length(p.text)).cast("long")
    # totals are taken of a column, so that the lengths are computed once
    sized = made.withColumn("_sizes", F.transform("parts", long)).withColumn("_ends", running_totals(F.col("_sizes")))
    whole = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p.lead, p.text)), ""), F.lit(END))

    def span(p: Column, end: Column) -> Column:
        n = F.length(p.text)
        return F.struct((end - n).cast("int").alias("start"), n.alias("length"), p.counts.alias("counts"))

    spans = F.filter(F.zip_with("parts", "_ends", span), lambda s: s.counts)
    shown = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.length.alias("length")))
    return sized.select(F.col("_key").alias(key), whole.alias("formatted"), shown.alias("loss_spans"))


def blocks(formatted: Column) -> Column:
    """The blocks of a formatted text, without their marks but still escaped: (role, texts)."""
    raw = F.slice(F.split(formatted, literal(TURN), -1), 2, 1 << 30)
    return F.transform(
        raw,
        lambda b: F.struct(
            F.element_at(F.split(b, literal(SAYS), 2), 1).alias("role"),
            F.split(F.element_at(F.split(b, literal(SAYS), 2), 2), literal(NEXT) + "|" + literal(END), -1).alias("pieces"),
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""

    def turns(b: Column) -> Column:
        kept = F.slice(b.pieces, 1, F.size(b.pieces) - 1)
        return F.transform(kept, lambda t: F.struct(unescaped(b.role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks(formatted), turns))


def digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from the formatted texts and their loss spans."""
    masked = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s.start + 1, s.length))), ""
    )
    read = chats.select(key, "formatted", read_turns(F.col("formatted")).alias("turns"), masked.alias("masked"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

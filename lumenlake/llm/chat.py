"""Chat formatting with Spark expressions only, with a loss mask and the way back.

A conversation's turns are collected as structs in chunks of turn numbers, sorted, and merged: adjacent turns of one
role become one block. Chunks are joined to conversations afterwards, and blocks that meet at a chunk's border are
merged as well, so no single task collects the rows of a long conversation turn by turn.

    <|start|>role<|message|>text<|part|>text of the next turn of that role<|end|><|start|>...<|end|>

Control strings inside roles and texts are escaped: after an opening `<` or `[` that begins one, a backslash is put in.
Strings that look escaped get one backslash more, so reading back takes exactly one away.

`mask` has one entry for each control string in `formatted`: of the characters from there to the next one, `skip` are
not under the loss, and `take` are. Only assistants' texts are under the loss.

Defined cases: null roles and texts are empty; null turns come first; turns with equal numbers are sorted by role, then
text; rows that repeat are all kept; a null conv_id is a conversation of its own; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
TRAINED = "assistant"
START, MESSAGE, PART, END = "<|start|>", "<|message|>", "<|part|>", "<|end|>"
# How control strings go on after their opening character, in this and other public templates.
_RESERVED = r"(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _RESERVED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _RESERVED, "$1$2$3")


def formatted(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, mask) of turns(conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / chunk).alias("chunk"),
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Each turn opens a block, or goes on with the block of the turn before it.
    merged = F.transform(
        "turns",
        lambda t, i: F.struct(
            ((i > 0) & (F.get("turns", i - 1)["role"] == t["role"])).alias("joins"), t["role"].alias("role"), escaped(t["text"]).alias("text")
        ),
    )
    chunks = sorted_turns.select(
        "conv_id",
        "chunk",
        F.aggregate(
            merged,
            F.array().cast("array<struct<role:string,texts:array<string>>>"),
            lambda blocks, t: F.when(
                t["joins"],
                F.concat(
                    F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))),
                    F.array(F.struct(t["role"].alias("role"), F.concat(F.element_at(blocks, -1)["texts"], F.array(t["text"])).alias("texts"))),
                ),
            ).otherwise(F.concat(blocks, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))),
        ).alias("blocks"),
    )
    talks = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk", F.lit(-(2**62))).alias("chunk"), "blocks"))).alias("chunks"))
    blocks = talks.select("conv_id", F.flatten(F.col("chunks.blocks")).alias("blocks"))
    # One piece for each text: what stands before it, the text, and how much of both is under the loss.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, i: F.transform(
                b["texts"],
                lambda text, j: F.struct(
                    F.when((j > 0) | (i > 0) & (F.get("blocks", i - 1)["role"] == b["role"]), F.lit(PART))
                    .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escaped(b["role"]), F.lit(MESSAGE)))
                    .alias("control"),
                    text.alias("text"),
                    (b["role"] == TRAINED).alias("trained"),
                ),
            ),
        )
    )
    cut = blocks.select("conv_id", pieces.alias("pieces"))
    entry = lambda skip, take: F.struct(skip.cast("int").alias("skip"), take.cast("int").alias("take"))
    none = F.lit(0)
    mask = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.concat(
                # An opening holds up to three control strings: the end of the block before, the start and the message.
                F.when(p["control"].startswith(END), F.array(entry(F.lit(len(END)), none))).otherwise(F.array().cast("array<struct<skip:int,take:int>>")),
                F.when(p["control"] == PART, F.array().cast("array<struct<skip:int,take:int>>")).otherwise(
                    F.array(entry(F.length(F.replace(p["control"], F.lit(END), F.lit(""))) - len(MESSAGE), none))
                ),
                F.array(
                    entry(
                        F.when(p["control"] == PART, len(PART)).otherwise(len(MESSAGE)) + F.when(p["trained"], 0).otherwise(F.length(p["text"])),
                        F.when(p["trained"], F.length(p["text"])).otherwise(0),
                    )
                ),
            ),
        )
    )
    return cut.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["control"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.concat(mask, F.array(entry(F.lit(len(END)), none))).alias("mask"),
    )


def turns_of(text: Column) -> Column:
    """The turns that a formatted conversation holds, read back: array<struct<role, text>>."""
    blocks = F.filter(F.split(text, r"<\|end\|>"), lambda b: b != "")
    parsed = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring_index(b, MESSAGE, -1), r"<\|part\|>"),
            lambda t: F.struct(
                unescaped(F.replace(F.substring_index(b, MESSAGE, 1), F.lit(START), F.lit(""))).alias("role"), unescaped(t).alias("text")
            ),
        ),
    )
    return F.flatten(parsed)


def under_loss(text: Column, mask: Column) -> Column:
    """The parts of a formatted text that its mask takes, unescaped and joined."""
    parts = F.zip_with(F.split(text, r"(?=<\|)"), mask, lambda p, m: unescaped(F.substring(p, m["skip"] + 1, m["take"])))
    return F.array_join(parts, "")

r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are merged under one header,
and everything is concatenated:

    <|im_start|>role<|message|>text<|turn|>text<|im_end|>

Inside roles and texts every backslash is doubled and every control string gets a backslash after its first character, so
a text can never open or close a turn, and reading back restores it exactly. The loss mask covers assistant texts only.

Defined cases: a null text or role is empty; texts of any length are kept whole; a row without conv_id is a conversation of
its own, which needs no shuffle, however many there are; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows keep one order and all stay; empty tables give no rows; extra columns, whatever their names, are ignored. A
conversation is one value of the result, so it must fit a row (2 GB); turns are gathered in chunks of CHUNK turn numbers
first, so no single aggregation step holds more than a chunk's rows or one conversation's chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that texts must not contain unescaped.
START, MESSAGE, TURN, END = "<|im_start|>", "<|message|>", "<|turn|>", "<|im_end|>"
CONTROL = (START, MESSAGE, TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
#: Roles whose texts are trained on.
LOSS_ROLES = ("assistant",)
CHUNK = 64
_PATTERN = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), _PATTERN, "\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, pieces): pieces is array<struct<text, loss>>, whose texts joined are `formatted`."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunk = F.floor(F.col("turn") / CHUNK).alias("chunk")
    chunks = rows.where("conv_id is not null").select("conv_id", chunk, turn.alias("t")).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ts"))).alias("cs"))
    turns = whole.select("conv_id", F.flatten(F.transform("cs", lambda c: c["ts"])).alias("ts"))
    turns = turns.union(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("ts")))
    before = F.lit(None).cast("string")

    def pieces(t: Column, i: Column) -> Column:
        ts = F.col("ts")
        last = F.when(i == 0, before).otherwise(F.get(ts, i - 1)["role"])
        following = F.get(ts, i + 1)["role"]
        head = F.when(last.eqNullSafe(t["role"]), F.lit(TURN)).otherwise(F.concat(F.lit(START), escape(t["role"]), F.lit(MESSAGE)))
        tail = F.when(following.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
        mark = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(mark(head, F.lit(False)), mark(escape(t["text"]), t["role"].isin(*LOSS_ROLES)), mark(tail, F.lit(False)))

    done = turns.select("conv_id", F.flatten(F.transform("ts", pieces)).alias("pieces"))
    return done.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: the exact inverse of the template."""
    def block(b: Column) -> Column:
        role = unescape(F.substring_index(b, MESSAGE, 1))
        texts = F.split(F.substring_index(F.substring_index(b, MESSAGE, -1), END, 1), re.escape(TURN), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, re.escape(START), -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")

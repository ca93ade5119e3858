"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted by (turn, role, text) as they are, before escaping; adjacent turns of one role are
merged into one message by an array aggregation, and everything is concatenated:

    <|im_start|>ROLE\\nTEXT[<|part|>TEXT ...]<|im_end|>\\n

``<|part|>`` keeps the limits of merged turns, so formatting loses nothing.  A control string
inside a role or text can't be mistaken: a backslash is doubled and ``<|`` becomes ``<\\|``
(a line break in a role becomes ``<\\.|``).  ``read_back`` undoes all of it.  The loss mask covers
the texts of assistant turns, without marks.

Null roles and texts count as empty; repeated rows stay; a null conv_id is a conversation of its
own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|part|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one string for each conversation of (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    # a turn that follows one of its own role continues the message, any other closes it and opens its own
    def piece(t: Column, i: Column) -> Column:
        role, text = F.replace(escape(t["role"]), F.lit("\n"), F.lit("<\\.|")), escape(t["text"])
        opened = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), role, F.lit("\n"), text)
        return F.when((i > 0) & (F.get("ts", i - 1)["role"] == t["role"]), F.concat(F.lit(PART), text)).otherwise(opened)

    return sorted_turns.select("conv_id", F.concat(F.array_join(F.transform("ts", piece), ""), F.lit(END)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>>: what the strings say, unescaped."""
    body = F.expr("substring(formatted, 1, length(formatted) - length('<|im_end|>') - 1)")
    messages = F.split(body, r"<\|im_end\|>\n")
    head = F.lit(len(START) + 1)

    def turns_of(m: Column) -> Column:
        inner = F.substring(m, head, F.length(m))
        cut = F.instr(inner, "\n")
        role = unescape_role(F.substring(inner, F.lit(1), cut - 1))
        texts = F.split(F.substring(inner, cut + 1, F.length(inner)), r"<\|part\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, turns_of)).alias("turns"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\.|"), F.lit("\n")))


def digest(back: DataFrame) -> DataFrame:
    """What op2 returns, from what was read back."""
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNED), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )

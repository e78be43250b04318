"""Chat formatting with a loss mask, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template's control strings. A block is one role's run of turns:
#   <|turn|>role \n text <|part|> text ... <|end|>
TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>"
# Characters that any control string begins with ("<|", "</s>", "[INST]") and the escape's own.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in pairs:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start from 0 and length, in code points).

    The turns are collected as structs and sorted by turn, role and text; adjacent turns
    of the same role are merged into one block, its parts kept apart by a mark; the
    blocks are concatenated. Texts and roles are escaped, so no control string of this
    template or another common one can come from a text. A span covers one part of a
    block of the ``trained`` role, without any mark.

    Null turns come first, null roles and texts count as empty, a null conv_id is a
    conversation of its own. Equal turn numbers are ordered by role and text, so the
    result does not depend on the order of rows; repeated rows stay. Other columns are
    ignored; an empty table gives no rows. A conversation is one row of the output and
    so must fit in memory.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("item"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # First places of the runs of one role.
    firsts = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: (i == 0) | (
        F.get("items", i)["role"] != F.get("items", i - 1)["role"]))
    chats = chats.withColumn("firsts", firsts)
    blocks = F.transform("firsts", lambda first, k: F.struct(
        F.get("items", first)["role"].alias("role"),
        F.transform(
            F.slice("items", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("items")) - first),
            lambda item: escaped(item["text"])).alias("parts")))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    pieces = F.transform("blocks", lambda b: F.concat(
        F.lit(TURN), escaped(b["role"], ROLE_ESCAPES), F.lit("\n"), F.array_join(b["parts"], PART), F.lit(END)))
    # Every part with the length of what stands before it since the part before.
    cuts = F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p, i: F.struct(
        (b["role"] == trained).alias("loss"), F.char_length(p).alias("length"),
        F.when(i > 0, F.lit(len(PART))).otherwise(
            len(TURN) + 1 + F.char_length(escaped(b["role"], ROLE_ESCAPES))).alias("lead"),
        F.when(i == F.size(b["parts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("tail")))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("cuts", state, lambda s, c: F.struct(
        (s["at"] + c["lead"] + c["length"] + c["tail"]).alias("at"),
        F.when(c["loss"], F.concat(s["spans"], F.array(F.struct(
            (s["at"] + c["lead"]).alias("start"), c["length"].alias("length"))))).otherwise(s["spans"]).alias("spans")))
    return chats.select("conv_id", F.array_join(pieces, "").alias("formatted"), cuts.alias("cuts")).select(
        "conv_id", "formatted", spans["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns (array of role and text) and the text under the loss mask, from formatted rows alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.struct(
        F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), "\n", 1).alias("role"), b.alias("block")))
    turns = F.flatten(F.transform(parsed, lambda p: F.transform(
        F.split(F.substr(p["block"], F.char_length(p["role"]) + len(TURN) + 2), r"<\|part\|>"),
        lambda t: F.struct(unescaped(p["role"], ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))

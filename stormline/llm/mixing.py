"""Mixing to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.llm.common import WORDS, row_key, whole_text, without
from stormline.session import pinned

SIDES = ("source", "lang", "topic")
# Share of a value in the target: in proportion to its tokens to this power. Below 1, large values give to small ones.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 10


def topic_of(text: Column, tokens: Column) -> Column:
    """A plain kind of text, from its length and its words per line."""
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(tokens == 0, "empty").when(tokens >= 1000, "long form").when(tokens < 8 * lines, "listing").otherwise("prose")


def rake(cells: DataFrame, powers: Mapping[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """Cells (the sides and ``tokens``) with ``weight``, whose sums follow the target of each side.

    Each step scales the weights of a side's values to their targets; a round takes every
    side once. A step is one window sum over cells, of which there are as many as
    combinations of values, not documents. Each round is written, and targets are taken from the
    given cells, so that no plan holds more than one round.
    """
    given = cells
    total = given.agg(F.sum("tokens").alias("total"))
    for side, power in powers.items():
        share = given.groupBy(side).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))
        norm = share.agg(F.sum("share").alias("norm"))
        # One row each: the sums of a side.
        share = share.join(F.broadcast(norm)).join(F.broadcast(total)).select(
            F.col(side).alias("_value"), (F.col("share") / F.col("norm") * F.col("total")).alias(f"_{side}"))
        cells = cells.join(share, F.col(side).eqNullSafe(F.col("_value"))).drop("_value")
    cells = pinned(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        for side in powers:
            now = F.sum("weight").over(Window.partitionBy(side))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_{side}") / now).otherwise(0.0))
        cells = pinned(cells)
    return cells.drop(*[f"_{side}" for side in powers])


def mix(docs: DataFrame, powers: Mapping[str, float] = POWERS, rounds: int = ROUNDS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, rate, copies, key.

    Tokens (words between ASCII white space) are summed by source, language and topic; the
    cells are raked to the targets of all three sides. ``rate`` is a cell's weight over its
    tokens, the expected number of copies of each of its documents; ``copies`` is its whole
    part plus one with the rest as probability, drawn from a hash of the doc_id, so a
    document's draw never depends on others or on the run.

    Null sources and languages are values of their own; null texts count as empty. Documents
    without tokens carry no weight and keep rate 1. Repeated rows get equal results. Other
    columns are ignored; an empty table gives no rows. A source that holds a third of all
    rows is summed before it moves.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"))
    rows = pinned(rows.select(
        "doc_id", "key", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens"))
    cells = rows.where("n_tokens > 0").groupBy(*SIDES).agg(F.sum("n_tokens").alias("tokens"))
    rates = rake(pinned(cells), powers, rounds).select(
        *[F.col(s).alias(f"_{s}") for s in SIDES], F.round(F.col("weight") / F.col("tokens"), 6).alias("rate"))
    same = None
    for s in SIDES:
        one = F.col(s).eqNullSafe(F.col(f"_{s}"))
        same = one if same is None else same & one
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    draw = draw.cast("double") / float(2 ** 52)
    out = rows.join(rates, same, "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("doc_id", *SIDES, "n_tokens", "rate", copies.cast("long").alias("copies"), "key")


def sample_mix(docs: DataFrame) -> DataFrame:
    """The documents drawn at least once, columns as they were."""
    return without(docs, mix(docs).where("copies = 0"))

"""Small shared pieces: reading a table and the word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stormline.session import pinned

# The byte classes that the word rules of the queries name.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


BROADCAST_ROWS = 1_000_000


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A number for the document that also tells rows with null identifiers apart by text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def packed(docs: DataFrame, **beside: Column) -> DataFrame:
    """Each whole row as the one column ``row``, with working columns beside it that can't clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[value.alias(name) for name, value in beside.items()])


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of these keys; texts move only if there are too many keys to broadcast.

    Columns and their values stay as they were, whatever their names.
    """
    keys = pinned(keys.select("key").distinct())
    few = keys.count() <= BROADCAST_ROWS
    rows = packed(docs, key=row_key(id_col, text_col))
    return rows.join(F.broadcast(keys) if few else keys, "key", "left_anti").select("row.*")

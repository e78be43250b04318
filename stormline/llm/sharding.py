"""Shards by rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.llm.common import whole_text
from stormline.session import pinned


def rendezvous_score(key: str, shard: int, weight: float) -> Column:
    """Exponential waiting time of a shard for a key: the smallest wins with odds in proportion to the weight."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2 ** 53)
    return -F.ln(uniform) / F.lit(float(weight))


def rendezvous(key: str, weights: Sequence[float]) -> Column:
    """The winning shard as a struct (score, shard); equal scores go to the lower shard."""
    return F.array_min(F.array(*[
        F.struct(rendezvous_score(key, i, w).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)]))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Each shard draws a score from the key and its own number, and the best one holds
    the row. Another shard changes no other score, so it takes rows only into itself;
    a share of the rows in proportion to its weight moves and no other. ``grown_shard``
    is the place with one shard of ``grown_weight`` more. Only the key decides, so a
    hot text or source is spread over all shards.

    ``slot`` numbers each shard's rows from 0 in order of doc_id: rows are
    range-partitioned by shard and key, numbered within partitions, and offset by the
    counts of earlier partitions, of which there are few. No shard meets in one task.

    Null texts have no bytes. Null keys share one shard. Repeated rows have the same
    shard and slots of their own. Other columns are ignored; an empty table gives no rows.
    """
    text = whole_text(text_col)
    best = rendezvous("doc_id", weights)
    placed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("best", best).select(
        "doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"),
        F.when(rendezvous_score("doc_id", len(weights), grown_weight) < F.col("best.score"), F.lit(len(weights)))
        .otherwise(F.col("best.shard")).alias("grown_shard"))
    order = ["shard", "doc_id", "text_crc32"]
    numbered = pinned(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("place", F.monotonically_increasing_id())
                      .withColumn("part", F.shiftright("place", 33)))
    # At most one row per partition and one more per shard.
    runs = numbered.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"),
        "grown_shard")

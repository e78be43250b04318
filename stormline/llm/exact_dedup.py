"""Exact deduplication by a content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stormline.llm.common import SPACES, whole_text
from stormline.session import pinned


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 256,
                lane_rows: int = 128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of white space became one space. Spark samples
    splitters and range-partitions the normalised bytes, sorts each range externally,
    and a window compares neighbouring whole texts. Splitters see the leading bytes and
    a hash of the text, so samples stay small; equality is always on the whole text.

    A text with more than ``crowd`` copies is spread over lanes of about ``lane_rows``
    copies, each a range of its own; the lanes' heads (one row each) are then combined
    by an aggregate on the whole text. No task sees a whole crowd.

    Null texts count as empty, empty texts equal each other. Null identifiers come last:
    a group of only such rows has a null keep_id and keeps one row. Among repeated rows
    with the same identifier and text exactly one is kept. Other columns are ignored. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(whole_text(text_col), SPACES, " ").alias("norm"))
    rows = rows.withColumn("mark", F.xxhash64("norm"))
    crowds = pinned(rows.groupBy("mark").count().where(F.col("count") > crowd)
                    .select("mark", F.ceil(F.col("count") / lane_rows).alias("lanes")))
    laned = rows.join(crowds, "mark", "left").select(
        "doc_id", "norm", "mark", F.col("lanes").isNotNull().alias("crowded"),
        F.when(F.col("lanes").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("lanes"))).alias("lane"),
        F.substring("norm", 1, 32).alias("head"))
    ranged = laned.repartitionByRange("head", "mark", "lane")
    same = Window.partitionBy("head", "mark", "norm", "lane")
    place = F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last()))
    placed = pinned(ranged.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), "crowded", place.alias("place"),
        F.min("doc_id").over(same).alias("lane_keep"), F.count(F.lit(1)).over(same).alias("lane_size"),
        F.when(F.col("crowded") & (place == 1), F.col("norm")).alias("head_text")))
    totals = pinned(placed.where("head_text is not null").groupBy("head_text").agg(
        F.first("text_sha256").alias("text_sha256"), F.min("lane_keep").alias("all_keep"),
        F.sum("lane_size").alias("all_size")).drop("head_text"))
    plain = placed.where("not crowded").select(
        "doc_id", F.col("lane_keep").alias("keep_id"), F.col("lane_size").alias("group_size"),
        (F.col("place") == 1).alias("kept"), "text_sha256")
    spread = placed.where("crowded").join(totals, "text_sha256").select(
        "doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("lane_keep").eqNullSafe(F.col("all_keep"))).alias("kept"), "text_sha256")
    return plain.unionByName(spread)

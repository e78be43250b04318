"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stormline.session import pinned


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the smallest node that can be reached.

    Alternating large-star and small-star steps: each is an aggregate and a join, each
    round a written table. A node of very many links is split by the skew join, as its
    side of the join carries one number. Null ends are ignored.
    """
    edges = pinned(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = pinned(small)
        # Both are sets of edges; one aggregate finds an edge that only one of them has.
        held = new.withColumn("side", F.lit(1)).union(edges.withColumn("side", F.lit(-1)))
        if held.groupBy("u", "v").agg(F.sum("side").alias("side")).where("side <> 0").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = new
    raise RuntimeError("the components did not settle")

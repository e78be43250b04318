"""The permanent history of samples, first seen wins, without reading it again for every batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from stormline.operators.ingest import first_seen
from stormline.session import pinned
from stormline.sources.ledger import append_batch, read_batches
from stormline.streaming.cells import struct

BUCKETS = 64
BITS = 32_768  # fixed value: bits of one of Spark's bitmaps
HASHES = 4
FILTERS = struct(bucket=T.IntegerType(), part=T.IntegerType(), bits=T.BinaryType())
ORDER = ["occurred_on", "precip_in"]


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _probes(keys: DataFrame, parts: int) -> DataFrame:
    """id, bucket and the places of the key in the Bloom filter of its bucket."""
    place = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(parts * BITS)) for j in range(HASHES)]))
    return keys.select("id", "bucket", place.alias("place")).select(
        "id", "bucket", F.floor(F.col("place") / BITS).cast("int").alias("part"), (F.col("place") % BITS).alias("bit"))


def bloom_rows(keys: DataFrame, parts: int) -> DataFrame:
    """The Bloom filters of keys (``id, bucket``): ``parts`` bitmaps a bucket at most."""
    return _probes(keys, parts).groupBy("bucket", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def suspects(keys: DataFrame, blooms: DataFrame, parts: int) -> DataFrame:
    """Keys that the filters can't rule out: all seen ones, and few others."""
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    merged = blooms.groupBy("bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    probes = _probes(keys, parts).join(merged, ["bucket", "part"])
    on = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("long") % 2 == 1
    return probes.where(on).groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).drop("n")


def fresh_samples(batch: DataFrame, path: str, number: int, buckets: int = BUCKETS, parts: int = 16) -> DataFrame:
    """Samples of the batch whose id no earlier batch has saved, the earliest of each id, with ``bucket``."""
    spark = batch.sparkSession
    rows = pinned(first_seen(batch.where("id is not null"), "id", ORDER).withColumn("bucket", bucket_of("id", buckets)))
    keys = rows.select("id", "bucket")
    touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    blooms = read_batches(spark, f"{path}/blooms", FILTERS, ["bucket"], before=number).where(F.col("bucket").isin(touched))
    maybe = pinned(suspects(keys, blooms, parts))
    asked = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
    known = saved_keys(spark, path, asked, number).join(maybe.select("id"), "id", "left_semi")
    return rows.join(known, "id", "left_anti").select(*rows.columns)


def saved_keys(spark: SparkSession, path: str, asked: list[int], before: int | None = None) -> DataFrame:
    """The ids saved in some buckets; folders of the others are not opened."""
    keys = struct(id=T.StringType(), bucket=T.IntegerType())
    return read_batches(spark, f"{path}/samples", keys, ["bucket"], before).where(F.col("bucket").isin(asked)).select("id")


def keep_history(samples: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, parts: int = 16) -> StreamingQuery:
    """Add the samples with unseen ids of each micro-batch to the permanent history.

    The history lies in buckets of its ids, each with a Bloom filter made of Spark's bitmaps.
    A micro-batch is first held against the filters of its buckets, and only buckets with
    an id that may be known are opened, the id column alone. New ids, nearly all in
    a feed that is polled, read nothing. ``parts * 32768`` bits a bucket are fixed for good; a
    filter that has filled up costs reads and never a result.

    Filters are written before samples, so a batch that breaks off between them leaves bits
    too many and none too few; it runs again as itself. Rows without id are left out.
    """
    def merge(batch: DataFrame, number: int) -> None:
        fresh = pinned(fresh_samples(batch, path, number, buckets, parts))
        append_batch(bloom_rows(fresh.select("id", "bucket"), parts), f"{path}/blooms", number, by=["bucket"])
        append_batch(fresh, f"{path}/samples", number, by=["bucket"])

    return samples.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All saved samples."""
    return read_batches(spark, f"{path}/samples", T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]),
                        ["bucket"]).select(*schema.fieldNames())

"""Streams of landed polls, samples and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from stormline.schemas import ADVISORY_OBJECT, POLLS, SENSOR_OBJECT, WATERBODY_OBJECT
from stormline.sources import payloads
from stormline.sources.ledger import read_batches
from stormline.streaming.cells import keep_batches

# What a poll of each kind becomes.
FLATTEN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "waterbodies": payloads.waterbody_rows,
    "sensors": payloads.sensor_rows,
    "WQ": lambda polls: payloads.advisory_rows(polls, "WQ"),
    "CSO": lambda polls: payloads.advisory_rows(polls, "CSO"),
}
OBJECTS = {"waterbodies": WATERBODY_OBJECT, "sensors": SENSOR_OBJECT, "WQ": ADVISORY_OBJECT, "CSO": ADVISORY_OBJECT}


# A compressed file isn't split, so each holds this many polls at most.
POLLS_A_FILE = 250_000


def land_polls(polls: DataFrame, landing: str) -> None:
    """Files of JSON lines as ``landed_polls`` reads them, compressed: a poll's text is many times its content."""
    stamped = polls.select(F.date_format("poll_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("poll_time_utc"), "payload")
    stamped.write.option("compression", "gzip").option("maxRecordsPerFile", POLLS_A_FILE).json(landing, ignoreNullFields=False)


def landed_polls(spark: SparkSession, landing: str) -> DataFrame:
    """Files of JSON lines with ``poll_time_utc`` and the raw ``payload`` text."""
    return spark.readStream.schema(POLLS).json(landing)


def append_log(polls: DataFrame, kind: str, path: str, checkpoint: str) -> StreamingQuery:
    """Flatten polls of one kind and append them to a log that is split by month.

    Polls that can't be read are passed over and counted in the observed metrics ``polls``.
    """
    rows = FLATTEN[kind](payloads.watched(polls, OBJECTS[kind], "polls")).withColumn("poll_month", F.date_format("poll_time_utc", "yyyy-MM"))
    return (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("poll_month")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedup_samples(samples: DataFrame, delay: str = "2 days") -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state is bounded by it."""
    return samples.withWatermark("occurred_on", delay).dropDuplicatesWithinWatermark(["id"])


def keep_state(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row per key: a running aggregate in Spark's state store, in update mode.

    A micro-batch is reduced before it moves, meets only the state of its own keys, and logs
    the keys whose row it touched. Late rows change nothing; ties go to the larger row.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("row")
    return keep_batches(rows.groupBy(*keys).agg(newest).select(*keys, "row.*"), out, checkpoint, "update")


def current_state(spark: SparkSession, out: str, keys: Sequence[str], order: Sequence[str], schema: T.StructType) -> DataFrame:
    """The newest row per key from the log that ``keep_state`` writes."""
    rest = [c for c in schema.fieldNames() if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("row")
    return read_batches(spark, out, schema).groupBy(*keys).agg(row).select(*keys, "row.*")

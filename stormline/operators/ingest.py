"""Ingest integrity: keys, first-seen merges, completeness and continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stormline.functions.clock import HOUR, micros, stamp
from stormline.operators.spans import with_previous


def record_key(own_id: Column, sensor: Column, occurred: Column) -> Column:
    """The record's own id, else gauge and time; a missing part reads 'None'."""
    def part(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    return F.coalesce(own_id.cast("string"), F.concat_ws("-", part(sensor), part(occurred)))


def first_seen(batch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the earliest by ``order``; copies collapse before the shuffle."""
    rest = [c for c in batch.columns if c != key]
    rank = F.struct(*(order or rest))
    return batch.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(key, "_row.*").select(
        *batch.columns)


def fresh_rows(history: DataFrame, batch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Rows of the batch whose key the history lacks.

    The history is first cut to the keys of the batch. A batch small enough to be
    broadcast then leaves the history unshuffled, however large it is.
    """
    known = history.select(key).join(batch.select(key), key, "left_semi")
    return first_seen(batch, key, order).join(known, key, "left_anti")


def history_merge(history: DataFrame, batch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """First seen wins: an existing key keeps its row, new keys are added once."""
    fresh = fresh_rows(history, batch, key, order)
    return history.unionByName(fresh.select(*history.columns))


def fresh_counts(history: DataFrame, batch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Fresh rows per gauge of the batch; a gauge with none has caught up."""
    fresh = fresh_rows(history, batch, key, order).groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("_fresh"))
    return batch.select("sensor_id").distinct().join(fresh, "sensor_id", "left").select(
        "sensor_id", F.coalesce("_fresh", F.lit(0).cast("long")).alias("fresh"),
        F.col("_fresh").isNull().alias("caught_up"))


def completeness(merged: DataFrame, prior: DataFrame, reached_end: DataFrame, updated: Column) -> DataFrame:
    """Records per gauge and whether its history was ever complete (a sticky flag).

    ``prior`` is the table of the run before; ``reached_end`` lists the gauges whose
    history was read to its end in this run.
    """
    counted = merged.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("records"), F.max("occurred_on").alias("latest"))
    before = prior.select("sensor_id", F.col("complete").alias("_before"))
    ended = reached_end.select("sensor_id").distinct().withColumn("_ended", F.lit(True))
    done = F.coalesce("_ended", F.lit(False)) | F.coalesce("_before", F.lit(False))
    return counted.join(before, "sensor_id", "left").join(ended, "sensor_id", "left").select(
        "sensor_id", done.alias("complete"), "records", "latest", updated.alias("updated"))


def backfill_order(sensors: DataFrame, state: DataFrame) -> DataFrame:
    """Gauges to harvest, incomplete or unknown ones first."""
    known = state.select("sensor_id", "complete")
    return sensors.select("sensor_id").distinct().join(known, "sensor_id", "left").select(
        "sensor_id", F.coalesce("complete", F.lit(False)).alias("complete")).orderBy("complete", "sensor_id")


def progress(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("gauges"))


def continuity_gaps(hourly: DataFrame) -> DataFrame:
    """Steps between consecutive stamps of a gauge that are not exactly one hour."""
    stamped = hourly.where(F.col("hour").isNotNull()).select("sensor_id", micros("hour").alias("_t"))
    steps = with_previous(stamped, ["sensor_id"], ["_t"], "_t", ["_t"])
    return steps.where(F.col("_t") - F.col("prev__t") != F.lit(HOUR)).select(
        "sensor_id", stamp("prev__t").alias("from_hour"), stamp("_t").alias("to_hour"),
        ((F.col("_t") - F.col("prev__t")) / F.lit(float(HOUR))).alias("step_hours"))

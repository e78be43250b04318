"""Sinks. Logs grow by batches that count once; histories are rewritten to a new path; results are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stormline.sources.ledger import append_batch, read_batches

SCORE_TIME = "run_time_utc"


def append_monthly(rows: DataFrame, path: str, batch: int, run: str = "0", at: str = "poll_time_utc") -> None:
    """Append a batch of polls to a log that is split by month; the same batch again replaces itself."""
    append_batch(rows.withColumn("poll_month", F.date_format(at, "yyyy-MM")), path, batch, run, by=["poll_month"])


def read_monthly(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log's committed rows with ``poll_month``, on which filters prune folders."""
    whole = T.StructType([*schema.fields, T.StructField("poll_month", T.StringType())])
    return read_batches(spark, path, whole, ["poll_month"]).drop("run", "batch")


def write_history(merged: DataFrame, version_path: str) -> None:
    """A gauge history sorted by gauge and time, to a fresh version path.

    Range partitions follow the data, so a gauge with a third of the rows spans many files.
    """
    merged.repartitionByRange("sensor_id", "occurred_on").sortWithinPartitions(
        "sensor_id", "occurred_on").write.mode("errorifexists").parquet(version_path)


def write_gauge_files(merged: DataFrame, version_path: str) -> None:
    """A gauge history as CSV in a folder per gauge, each file sorted by time, to a fresh version path."""
    merged.withColumn("gauge", F.col("sensor_id")).repartitionByRange("sensor_id", "occurred_on").sortWithinPartitions(
        "gauge", "occurred_on").write.mode("errorifexists").option("header", True).partitionBy("gauge").csv(version_path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a result table where it lies; ``form`` is ``parquet`` or ``csv``. Don't read it meanwhile."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def append_scores(scores: DataFrame, path: str, run: str) -> None:
    """Add this run's one row to the score log, with the time of the run; a run that is repeated has one row."""
    append_batch(scores.withColumn(SCORE_TIME, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), path, 0, run)


def read_scores(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per run, with its name and time; ``schema`` is that of the scores."""
    whole = T.StructType([*schema.fields, T.StructField(SCORE_TIME, T.StringType())])
    return read_batches(spark, path, whole).drop("batch")


def write_filings(cleaned: DataFrame, subset: DataFrame, statewide_path: str, city_path: str) -> None:
    write_table(cleaned, statewide_path)
    write_table(subset, city_path)

"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stormline import schemas
from stormline.operators.filings import ROW_NO
from stormline.sources.files import visible

# Fixed value: the legacy layer's way to write "no date", in epoch milliseconds.
NO_DATE_MS = -62135596800000


def gauge_history(spark: SparkSession, path: str) -> DataFrame:
    """All gauge files of a folder; the file's name is the gauge, whatever the column says.

    Where gauges have folders (``gauge=BB/``, as ``writers.write_gauge_files`` leaves them), the folder's name is.
    """
    rows = spark.read.schema(schemas.READINGS).option("header", True).csv(path, pathGlobFilter="*.csv*")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv", 1)
    gauge = F.col("gauge").cast("string") if "gauge" in rows.columns else stem
    return rows.select("id", gauge.alias("sensor_id"), "occurred_on", "precip_in")


def waterbody_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WATERBODY_LOG).option("header", True).csv(path)


def sensor_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SENSOR_LOG).option("header", True).csv(path)


def advisory_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ADVISORY_LOG).option("header", True).csv(path)


def model_config(spark: SparkSession, path: str) -> DataFrame:
    """The nested configuration, one row per waterbody."""
    return spark.read.schema(schemas.WATERBODY_OBJECT).option("multiLine", True).json(path)


def completeness_state(spark: SparkSession, path: str) -> DataFrame:
    """The harvest markers: one JSON object keyed by gauge, as one row per gauge."""
    path = visible(spark, path)
    entry = "map<string,struct<complete:boolean,records:bigint,updated:string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", entry)).alias("sensor_id", "_m")).select(
        "sensor_id", F.col("_m.complete").alias("complete"), F.col("_m.records").alias("records"),
        F.try_to_timestamp(F.col("_m.updated")).alias("updated"))


def legacy_date(ms: Column) -> Column:
    """Epoch milliseconds to a stamp; the mark for no date becomes null first."""
    return F.timestamp_millis(F.nullif(ms, F.lit(NO_DATE_MS)))


def legacy_layer(spark: SparkSession, path: str) -> DataFrame:
    """The legacy parameter layer, one row per waterbody."""
    features = spark.read.schema(schemas.LEGACY_LAYER).option("multiLine", True).json(path)
    a = features.select(F.explode("features").alias("f")).select("f.attributes.*")
    return a.select(
        F.col("WBID").alias("wbid"), F.trim("Waterbod_1").alias("waterbody"), F.col("Prim_RainG").alias("gauge"),
        *[F.col(f"{c.upper()}_Curve").alias(c) for c in "abcdef"],
        F.col("Rainfall_T").alias("threshold_in"), F.col("peak_inten").alias("peak_in"),
        (F.col("manual_ove") != 0).alias("manual_override"), (F.col("Advisory") != 0).alias("on_advisory"),
        F.col("Hours").alias("hours_left"), legacy_date(F.col("Expires")).alias("expires"),
        legacy_date(F.col("Creation_1")).alias("created"), legacy_date(F.col("EditDate_1")).alias("edited"))


def filing_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One sheet (or one folder of sheets sharing a header) as text columns, with each row's place in its file.

    A sheet is read by one task, as its cells may hold line ends, so its rows are numbered in their order.
    """
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.withColumn(ROW_NO, F.monotonically_increasing_id())

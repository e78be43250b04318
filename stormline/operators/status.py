"""Current-status views over all gauges and waterbodies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.functions.clock import HOUR, micros, stamp
from stormline.functions.text import contains_keyword

LAST_SAMPLES = 96
ACCUMULATED_SAMPLES = 24

# The longest bar, in hours, per advisory type.
MAX_HOURS = {"CSO": 6, "WQ": 200}
OTHER_MAX_HOURS = 48

# Upper bounds of the volume classes in million gallons, with their labels.
VOLUME_CLASSES = [
    (0, "No discharge"), (5, "≤5 MG"), (20, "≤20 MG"), (50, "≤50 MG"),
    (200, "≤200 MG"), (500, "≤500 MG"), (1000, "≤1,000 MG"),
]
TOP_VOLUME_CLASS = ">1,000 MG"

# Water classes with their labels and best usages.
WATER_CLASSES = {
    "SA": ("Class SA", "Best usages are shellfishing for market purposes, primary and secondary contact recreation and fishing"),
    "SB": ("Class SB", "Best usages are primary and secondary contact recreation and fishing"),
    "SB(WW)": ("Class SB(WW)", "Best usages of Class SB waters with limited suspension following qualifying rain events"),
    "SC": ("Class SC", "Best usage is fishing. Factors other than water quality limit recreational uses."),
    "I": ("Class I", "Best usages are secondary contact recreation and fishing"),
    "SD": ("Class SD", "Best usage is fishing. Natural or man-made conditions limit fish propagation."),
}


def last_samples(hourly: DataFrame, n: int = LAST_SAMPLES) -> DataFrame:
    """The newest ``n`` samples of every gauge; tasks keep at most ``n`` per gauge before the shuffle."""
    newest = Window.partitionBy("sensor_id").orderBy(F.desc("hour"))
    return hourly.withColumn("sample_no", F.row_number().over(newest)).where(F.col("sample_no") <= n)


def accumulated_rain(hourly: DataFrame, n: int = ACCUMULATED_SAMPLES) -> DataFrame:
    """Rain over the newest ``n`` samples (samples and not clock hours)."""
    return last_samples(hourly, n).groupBy("sensor_id").agg(
        F.coalesce(F.sum("precip"), F.lit(0)).cast("decimal(18,4)").alias("rain_in"), F.count(F.lit(1)).alias("samples"))


def advisory_status(advisories: DataFrame) -> DataFrame:
    """Active when hours are left; the end drops the fraction of an hour."""
    active = F.coalesce(F.col("duration_hr") > 0, F.lit(False))
    whole = F.floor("duration_hr").cast("long")
    until = F.when(active, stamp(micros("occurred_on") + whole * F.lit(HOUR)))
    return advisories.withColumn("has_advisory", active).withColumn("until", until)


def status_list(status: DataFrame, keyword: str = "", only_on_advisory: bool = False) -> DataFrame:
    """Waterbodies matching a keyword, optionally only those on advisory, by name."""
    kept = status.where(contains_keyword(F.col("name"), keyword))
    if only_on_advisory:
        kept = kept.where(F.col("has_advisory"))
    return kept.orderBy(F.lower("name"), "name")


def volume_class(volume: Column) -> Column:
    v = F.coalesce(volume, F.lit(0.0))
    bound, label = VOLUME_CLASSES[0]
    chain = F.when(v == bound, label)
    for bound, label in VOLUME_CLASSES[1:]:
        chain = chain.when(v <= bound, label)
    return chain.otherwise(TOP_VOLUME_CLASS)


def progress_percent(hours: Column, kind: Column) -> Column:
    """Share of the type's longest bar, capped at 100; 0 without an advisory."""
    longest = F.lit(OTHER_MAX_HOURS)
    for name, value in MAX_HOURS.items():
        longest = F.when(F.upper(kind) == name, value).otherwise(longest)
    return F.when(hours > 0, F.least(hours, longest) / longest * 100).otherwise(F.lit(0.0))


def resolve_gauges(waterbodies: DataFrame, gauges: DataFrame) -> DataFrame:
    """The gauge a waterbody names by id or by name; an id match comes first.

    Two equi-joins, as a single join on either would compare every pair.
    """
    ids = gauges.select(F.col("sensor_id").alias("_id")).distinct()
    names = gauges.where(F.col("sensor_name").isNotNull()).groupBy(F.col("sensor_name").alias("_name")).agg(
        F.min("sensor_id").alias("_by_name"))
    named = F.when(F.col("gauge_ref") != "", F.col("gauge_ref"))
    return (
        waterbodies.withColumn("_ref", named)
        .join(ids, F.col("_ref") == F.col("_id"), "left")
        .join(names, F.col("_ref") == F.col("_name"), "left")
        .withColumn("sensor_id", F.coalesce("_id", "_by_name"))
        .drop("_ref", "_id", "_name", "_by_name")
    )


def water_class(code: Column) -> Column:
    """Label and description of a class code as a struct; null for an unknown code."""
    empty = F.lit(None).cast("struct<label:string,description:string>")
    chain = None
    for name, (label, description) in WATER_CLASSES.items():
        info = F.struct(F.lit(label).alias("label"), F.lit(description).alias("description"))
        chain = F.when(code == name, info) if chain is None else chain.when(code == name, info)
    return chain.otherwise(empty)

"""Advisory episodes from storms and waterbody parameters, and their burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stormline.functions.clock import DAY, HOUR, hours_between, micros, stamp
from stormline.functions.numbers import round_half_even
from stormline.operators.panel import DEPTH
from stormline.operators.spans import fold_spans, match_spans

# Fixed values of the advisory model.
PEAK_TRIGGER_IN = "0.05"
HOURS_PER_YEAR = 8766


def depth_reaches(depth: Column, threshold: Column) -> Column:
    """Both sides as decimals: a depth equal to the threshold triggers."""
    return depth >= threshold.cast(DEPTH)


def triggered(storms: DataFrame, params: DataFrame) -> DataFrame:
    """Storms joined to the waterbodies on their gauge that reach the trigger."""
    return storms.join(params, "sensor_id").where(
        depth_reaches(F.col("depth"), F.col("wq_threshold_in"))
        & (F.col("peak") >= F.lit(PEAK_TRIGGER_IN).cast(DEPTH)))


def advisory_hours(depth: Column, a: Column, b: Column) -> Column:
    return F.ceil(a * F.pow(depth.cast("double"), b))


def advisory_until(storms: DataFrame, params: DataFrame) -> DataFrame:
    """Every triggered storm with its advisory's end, counted from the last wet hour."""
    hours = advisory_hours(F.col("depth"), F.col("wq_coeff_a"), F.col("wq_coeff_b"))
    return triggered(storms, params).withColumn("hours", hours).select(
        "waterbody", "sensor_id", "start", "end", "depth", "peak", "hours",
        stamp(micros("end") + F.col("hours") * F.lit(HOUR)).alias("until"))


def merge_advisories(advisories: DataFrame, keys: tuple[str, ...] = ("waterbody",),
                     cell_length: int = 30 * DAY, combine: bool = False) -> DataFrame:
    """Merge overlapping or touching advisories of the same key."""
    spans = advisories.select(*keys, micros("start").alias("_s"), micros("until").alias("_u"))
    merged = fold_spans(spans, list(keys), "_s", "_u", cell_length=cell_length, combine=combine)
    return merged.select(*keys, stamp("start_us").alias("start"), stamp("end_us").alias("until"))


def episodes(storms: DataFrame, params: DataFrame) -> DataFrame:
    merged = merge_advisories(advisory_until(storms, params))
    return merged.withColumn("dur_hr", hours_between(F.col("start"), F.col("until")))


def waterbody_summary(params: DataFrame, episodes: DataFrame, reliable: DataFrame) -> DataFrame:
    """Rates per waterbody, most burdened first; waterbodies without episodes show zeros."""
    # Durations are whole hours, so the exact median holds few distinct values per waterbody.
    per_body = episodes.groupBy("waterbody").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("dur_hr").alias("_hours"), F.median("dur_hr").alias("_median"))
    n, hours = F.coalesce("_n", F.lit(0)), F.coalesce("_hours", F.lit(0.0))
    years = F.col("reliable_hours") / F.lit(HOURS_PER_YEAR)
    return (
        params.join(reliable, "sensor_id").join(per_body, "waterbody", "left")
        .select(
            "waterbody", F.col("sensor_id").alias("gauge"), F.col("wq_threshold_in").alias("threshold_in"),
            F.try_divide(n, years).alias("_per_yr"), F.try_divide(hours, years).alias("_hours_yr"),
            F.try_divide(F.lit(100.0) * hours, F.col("reliable_hours").cast("double")).alias("_pct"),
            F.coalesce("_median", F.lit(0.0)).alias("_median"),
        )
        .select(
            "waterbody", "gauge", "threshold_in",
            round_half_even(F.col("_per_yr"), 1).alias("episodes_per_yr"),
            round_half_even(F.col("_hours_yr"), 0).cast("long").alias("adv_hours_per_yr"),
            round_half_even(F.col("_pct"), 1).alias("pct_time"),
            round_half_even(F.col("_median"), 0).cast("long").alias("median_dur_hr"),
        )
        .orderBy(F.desc("pct_time"), "waterbody")
    )


def burden_topk(summary: DataFrame, k: int = 5) -> DataFrame:
    """The k most and the k least burdened waterbodies."""
    most = summary.orderBy(F.desc("pct_time"), "waterbody").limit(k).withColumn("side", F.lit("most"))
    least = summary.orderBy(F.asc("pct_time"), "waterbody").limit(k).withColumn("side", F.lit("least"))
    return most.unionByName(least).select("side", "waterbody", "gauge", "pct_time")


def published(advisory_log: DataFrame) -> DataFrame:
    """One row per logged advisory, the earliest poll, with its published end."""
    first = advisory_log.where(F.col("occurred_on").isNotNull()).groupBy("waterbody", "occurred_on").agg(
        F.min(F.struct("poll_time_utc", "duration_hr")).alias("_first"))
    return first.select(
        "waterbody", "occurred_on", F.col("_first.duration_hr").alias("duration_hr"),
        stamp(micros("occurred_on") + F.round(F.col("_first.duration_hr") * F.lit(HOUR)).cast("long"))
        .alias("published_until"))


def live_check(advisory_log: DataFrame, episodes: DataFrame) -> DataFrame:
    """Published advisory ends beside the reconstructed episode that covers their onset."""
    spans = episodes.select("waterbody", micros("start").alias("start_us"), micros("until").alias("end_us"),
                            F.col("until").alias("episode_until"))
    matched = match_spans(
        published(advisory_log), micros("occurred_on"), spans, keys=["waterbody"], how="left")
    return matched.select(
        "waterbody", "occurred_on", "published_until", "episode_until",
        hours_between(F.col("published_until"), F.col("episode_until")).alias("diff_hr"))


def observed_status(waterbody_log: DataFrame, advisory_log: DataFrame) -> DataFrame:
    """On/off per poll, waterbody and type; a waterbody absent from a poll's list is off."""
    types = F.explode(F.array(F.lit("WQ"), F.lit("CSO"))).alias("advisory_type")
    polls = waterbody_log.select("poll_time_utc", "waterbody").distinct().select("*", types)
    listed = advisory_log.select("poll_time_utc", "waterbody", "advisory_type").distinct().withColumn(
        "_on", F.lit(True))
    return polls.join(listed, ["poll_time_utc", "waterbody", "advisory_type"], "left").select(
        "poll_time_utc", "waterbody", "advisory_type", F.coalesce("_on", F.lit(False)).alias("on_advisory"))

"""Independent filings held against the reconstructed advisories.

Whether *any* advisory is active at a time depends on the union of all episodes. That
union is folded once; it is disjoint, so a bucket holds few spans however many
waterbodies there are, and no pair of filing and episode is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stormline.functions.clock import DAY, HOUR, cell_of, micros, stamp
from stormline.operators.filings import city_subset
from stormline.operators.spans import bucketed, fold_spans, match_spans


def wet_weather_city_filings(cleaned: DataFrame, words: tuple[str, ...] = ("rain", "cso")) -> DataFrame:
    """City filings whose reason mentions wet weather."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | reason.contains(word)
    return city_subset(cleaned).where(hit)


def active_spans(episodes: DataFrame) -> DataFrame:
    """The disjoint times at which any waterbody is under advisory."""
    spans = episodes.select(micros("start").alias("_s"), micros("until").alias("_u"))
    return fold_spans(spans, [], "_s", "_u", combine=True)


def onset_spans(episodes: DataFrame, hours: int = 24) -> DataFrame:
    """The disjoint times within ``hours`` of any onset."""
    reach = F.lit(hours * HOUR)
    spans = episodes.select(micros("start").alias("_t")).select(
        (F.col("_t") - reach).alias("_s"), (F.col("_t") + reach).alias("_u"))
    return fold_spans(spans, [], "_s", "_u", combine=True)


def filings_active(filings: DataFrame, episodes: DataFrame) -> DataFrame:
    return match_spans(filings, micros("start_dt"), active_spans(episodes), how="left_semi")


def filings_unmatched(filings: DataFrame, episodes: DataFrame) -> DataFrame:
    return match_spans(filings, micros("start_dt"), active_spans(episodes), how="left_anti")


def filings_near_onset(filings: DataFrame, episodes: DataFrame, hours: int = 24) -> DataFrame:
    return match_spans(filings, micros("start_dt"), onset_spans(episodes, hours), how="left_semi")


def match_shares(filings: DataFrame, episodes: DataFrame, hours: int = 24) -> DataFrame:
    """One row: filings, those in an advisory, those near an onset, and both shares."""
    # The spans are disjoint, so a left join keeps one row per filing.
    times = filings.select(micros("start_dt").alias("_f"))
    active = active_spans(episodes).withColumn("_active", F.lit(True))
    near = onset_spans(episodes, hours).withColumn("_near", F.lit(True))
    flagged = match_spans(times, "_f", active, how="left").select("_f", "_active")
    flagged = match_spans(flagged, "_f", near, how="left")
    counts = flagged.agg(
        F.count(F.lit(1)).alias("filings"), F.count("_active").alias("active"), F.count("_near").alias("near_onset"))
    return counts.select("*", F.try_divide("active", "filings").alias("active_share"),
                         F.try_divide("near_onset", "filings").alias("near_onset_share"))


def onset_clusters(
    filings: DataFrame, episodes: DataFrame, gap_hours: float = 24, reach_hours: int = 24,
) -> DataFrame:
    """Clusters of onsets, the waterbodies each touches, and whether a filing is near.

    Onset times are made distinct before they are folded.
    """
    onsets = episodes.select("waterbody", micros("start").alias("_t"))
    clusters = fold_spans(onsets.select("_t").distinct(), [], "_t", "_t", gap=int(gap_hours * HOUR))
    members = match_spans(onsets, "_t", clusters, how="inner")
    touched = members.groupBy("start_us", "end_us").agg(
        F.count(F.lit(1)).alias("onsets"), F.countDistinct("waterbody").alias("waterbodies"))
    reach = F.lit(reach_hours * HOUR)
    times = filings.select(micros("start_dt").alias("_f")).distinct().withColumn("_bucket", cell_of(F.col("_f"), DAY))
    padded = touched.select(
        "start_us", (F.col("start_us") - reach).alias("_from"), (F.col("end_us") + reach).alias("_to"))
    near = bucketed(padded, "_from", "_to").join(
        times.withColumnRenamed("_bucket", "_b"),
        (F.col("_bucket") == F.col("_b")) & F.col("_f").between(F.col("_from"), F.col("_to")), "left_semi",
    ).select("start_us").distinct().withColumn("_hit", F.lit(True))
    return touched.join(near, "start_us", "left").select(
        stamp("start_us").alias("cluster_start"), stamp("end_us").alias("cluster_end"), "onsets", "waterbodies",
        F.coalesce("_hit", F.lit(False)).alias("has_filing"))


def size_bucket(waterbodies: Column) -> Column:
    # The cluster sizes that are compared.
    return F.when(waterbodies >= 10, "10+").when(waterbodies <= 2, "1-2").otherwise("3-9")


def cluster_match_rates(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(size_bucket(F.col("waterbodies")).alias("size")).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("has_filing").alias("matched")
    ).withColumn("match_rate", F.col("matched") / F.col("clusters"))


def yearly_compare(filings: DataFrame, episodes: DataFrame, gap_hours: float = 24) -> DataFrame:
    """Filings, waterbody onsets and city onset clusters per year."""
    filed = filings.groupBy(F.year("start_dt").alias("year")).agg(F.count(F.lit(1)).alias("filings"))
    onsets = episodes.groupBy(F.year("start").alias("year")).agg(F.count(F.lit(1)).alias("onsets"))
    times = episodes.select(micros("start").alias("_t")).distinct()
    clusters = fold_spans(times, [], "_t", "_t", gap=int(gap_hours * HOUR)).groupBy(
        F.year(stamp("start_us")).alias("year")).agg(F.count(F.lit(1)).alias("clusters"))
    joined = filed.join(onsets, "year", "full_outer").join(clusters, "year", "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select("year", *[F.coalesce(c, zero).alias(c) for c in ("filings", "onsets", "clusters")])

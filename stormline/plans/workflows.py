"""The reference jobs end to end, each as one declarative plan plus its writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from stormline.operators import advisories, cso, filings, panel, params, storms
from stormline.session import pinned
from stormline.sources import writers


def reconstruct(
    readings: DataFrame, waterbody_log: DataFrame, rules: panel.QualityRules = panel.QualityRules(),
    order: Sequence[str] = ("poll_time_utc",),
) -> tuple[DataFrame, DataFrame]:
    """Readings and polled parameters to ``(summary, episodes)``."""
    grid = panel.panel_grid(panel.dedup_hours(readings))
    return summarise(panel.quality_control(grid, rules), params.latest_params(waterbody_log, order))


def summarise(controlled: DataFrame, dimension: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A controlled panel and parameters to ``(summary, episodes)``.

    Storms and reliable hours both read the panel, so its costly chain is written once.
    """
    controlled = pinned(controlled)
    found = advisories.episodes(storms.storms(controlled), dimension)
    return advisories.waterbody_summary(dimension, found, panel.reliable_hours(controlled)), found


def write_reconstruction(
    spark: SparkSession, readings: DataFrame, waterbody_log: DataFrame, summary_path: str, episodes_path: str,
    rules: panel.QualityRules = panel.QualityRules(), form: str = "parquet",
) -> None:
    """Write both results; the summary is computed from the written episodes."""
    dimension = params.latest_params(waterbody_log)
    controlled = pinned(panel.quality_control(panel.panel_grid(panel.dedup_hours(readings)), rules))
    found = advisories.episodes(storms.storms(controlled), dimension)
    writers.write_table(found, episodes_path, form)
    written = spark.read.schema(found.schema)
    saved = written.option("header", True).csv(episodes_path) if form == "csv" else written.parquet(episodes_path)
    summary = advisories.waterbody_summary(dimension, saved, panel.reliable_hours(controlled))
    writers.write_table(summary, summary_path, form)


def score_overflows(
    advisory_log: DataFrame, waterbody_log: DataFrame, config: DataFrame, readings: DataFrame,
    order: Sequence[str] = ("poll_time_utc",),
) -> DataFrame:
    """Every usable overflow observation with its storm state and both predictions."""
    states = cso.attach_storm_state(
        cso.cso_observations(advisory_log, tuple(order)), params.gauge_map(waterbody_log, order),
        panel.dedup_hours(readings))
    return cso.predictions(states, params.cso_params(config))


def write_overflow_scores(predicted: DataFrame, estimates_path: str, log_path: str, run: str) -> DataFrame:
    """Overwrite the estimates, append the scores of this run, and return the refits."""
    predicted = pinned(predicted)
    writers.write_table(cso.estimates(predicted), estimates_path)
    writers.append_scores(cso.scores(predicted), log_path, run)
    return cso.refit(predicted)


def clean_workbook(sheets: Mapping[str, DataFrame], statewide_path: str, city_path: str) -> DataFrame:
    """All sheets to a statewide and a city table; returns the coverage row."""
    raw = filings.union_sheets(sheets)
    cleaned = pinned(filings.clean_filings(raw))
    exported = filings.export_columns(cleaned)
    writers.write_filings(exported, filings.city_subset(exported), statewide_path, city_path)
    return filings.filing_coverage(raw, cleaned)

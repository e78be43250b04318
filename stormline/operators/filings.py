"""Discharge filings: one canonical table from sheets of several schema eras."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.functions.text import parse_duration_hours, parse_filing_date, strip

ROW_NO = "_row_no"  # column of a sheet with the place of each row in it

# Canonical column and the headers seen for it, in order of preference.
ALIASES = {
    "facility": ["POTW/POSS Name", "Facility Name", "facilityName", "facility name"],
    "facility_id": ["POTW/POSS ID", "Facility ID", "facilityId", "sprtk id"],
    "start": ["Discharge Start Date", "Start Date", "sprtkStartDischargeDatetime", "start time"],
    "end": ["Discharge End Date", "End Date", "sprtkEndDischargeDatetime"],
    "duration": ["Duration", "dischargeDuration", "duration"],
    "waterbody": ["Receiving Water Body", "receivingWaterBody", "affected water body"],
    "quantity": ["Quantity/Volume", "quantity"],
    "treated": ["Treated State", "treatedState", "treated state"],
    "reason": ["Reason", "dischargeReason", "reasons for discharge"],
    "county": ["County", "countyName", "county"],
    "city": ["City", "city"],
    "status": ["Notification Status", "notificationStatus"],
    "incident_id": ["Incident ID", "incidentId"],
    "notif_id": ["Notification ID", "notificationId"],
    "lat": ["Latitude", "latitude"],
    "lon": ["Longitude", "longitude"],
}

# Counties and boroughs of the city subset, and its facility mark.
CITY_COUNTIES = ["bronx", "kings", "queens", "new york", "richmond", "brooklyn", "manhattan", "staten island"]
CITY_FACILITY = "NYCDEP"

# The exported columns, in order.
EXPORT = ["start_dt", "end", "duration", "duration_hours", "facility", "facility_id", "waterbody", "quantity",
          "treated", "reason", "county", "city", "status", "incident_id", "lat", "lon", "sheet"]


def normalize_sheet(sheet: DataFrame, name: str | Column, row_no: Column | None = None) -> DataFrame:
    """The 16 canonical columns as text, from the first header present for each.

    Header case decides, as 'Duration' and 'duration' belong to different eras.
    """
    present = set(sheet.columns)

    def canonical(wanted: list[str]) -> Column:
        header = next((h for h in wanted if h in present), None)
        return F.lit(None).cast("string") if header is None else F.col(f"`{header}`").cast("string")

    return sheet.select(
        *[canonical(headers).alias(c) for c, headers in ALIASES.items()],
        (F.lit(name) if isinstance(name, str) else name).alias("sheet"),
        (row_no if row_no is not None else F.lit(None).cast("long")).alias("row_no"),
    )


def union_sheets(sheets: Mapping[str, DataFrame], row_no: str = ROW_NO) -> DataFrame:
    """All sheets as one table, each row tagged with its sheet and its place in it.

    The place is the column ``row_no`` of a sheet, as the reader of sheets gives it; where that
    is missing, the order in which Spark holds the rows.
    """
    def place(sheet: DataFrame) -> Column:
        return F.col(row_no).cast("long") if row_no in sheet.columns else F.monotonically_increasing_id()

    return reduce(DataFrame.unionByName, (normalize_sheet(df, name, place(df)) for name, df in sheets.items()))


def with_dates(filings: DataFrame) -> DataFrame:
    return filings.withColumn("start_dt", parse_filing_date(F.col("start")))


def with_duration_hours(filings: DataFrame) -> DataFrame:
    return filings.withColumn("duration_hours", parse_duration_hours(F.col("duration")))


def duplicate_key(facility: Column, start: Column, waterbody: Column, duration: Column) -> Column:
    """Facility, start, waterbody and duration as one key; blank and absent parts are equal."""
    def part(c: Column) -> Column:
        return F.coalesce(F.lower(strip(c)), F.lit(""))

    return F.concat_ws("|", *[part(c) for c in (facility, start, waterbody, duration)])


def dedup_filings(filings: DataFrame) -> DataFrame:
    """Drop rows without a start date, then repeats across sheets; the last sheet row stays.

    Ranked with a bound of one, so each task keeps one row per key before the shuffle
    and a mass of copies, or of padding, never meets in one place. Rows without a date
    have keys of their own and leave after the ranking; a filter ahead of it would
    parse every date twice.
    """
    keyed = with_dates(filings).withColumn(
        "dupkey", duplicate_key(*[F.col(c) for c in ("facility", "start_dt", "waterbody", "duration")]))
    latest = Window.partitionBy("dupkey").orderBy(
        F.desc("sheet"), F.desc_nulls_last("row_no"), F.desc_nulls_last("incident_id"))
    return keyed.withColumn("_rank", F.row_number().over(latest)).where(
        (F.col("_rank") == 1) & F.col("start_dt").isNotNull()).drop("_rank")


def is_city(county: Column, facility: Column) -> Column:
    by_county = F.coalesce(F.lower(strip(county)).isin(CITY_COUNTIES), F.lit(False))
    by_facility = F.coalesce(F.upper(facility).contains(CITY_FACILITY), F.lit(False))
    return by_county | by_facility


def city_subset(filings: DataFrame) -> DataFrame:
    return filings.where(is_city(F.col("county"), F.col("facility")))


def clean_filings(filings: DataFrame) -> DataFrame:
    """Canonical filings, dated, deduplicated and with numeric durations."""
    return with_duration_hours(dedup_filings(filings))


def export_columns(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*EXPORT)


def filing_coverage(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Row counts from raw to city subset, coverage, and the parseable share of durations."""
    start = with_dates(raw).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count("start_dt").alias("dated_rows"),
        F.count_if(F.col("start").isNotNull() & (strip(F.col("start")) != "") & F.col("start_dt").isNull())
        .alias("unparsed_dates"))
    kept = cleaned.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(is_city(F.col("county"), F.col("facility"))).alias("city_rows"),
        F.min("start_dt").alias("first_start"), F.max("start_dt").alias("last_start"),
        F.try_divide(F.count("duration_hours"), F.count("duration")).alias("duration_share"))
    # Two one-row results put side by side; each column is filled in one of them.
    both = start.unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*start.columns, *kept.columns]])

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stormline.functions.text import parse_duration_hours, parse_filing_date
from stormline.operators import crosscheck, filings
from stormline.plans import workflows
from tests.conftest import ORIGIN, at, hours

DATES = {
    "2021-05-01 03:04:05": dt.datetime(2021, 5, 1, 3, 4, 5), "2021-05-01T03:04:05": dt.datetime(2021, 5, 1, 3, 4, 5),
    "2021-05-01": dt.datetime(2021, 5, 1), "20210501": dt.datetime(2021, 5, 1), " 5/1/2021 3:04 ": dt.datetime(2021, 5, 1, 3, 4),
    "05/01/2021 03:04:05": dt.datetime(2021, 5, 1, 3, 4, 5), "5/1/2021": dt.datetime(2021, 5, 1),
    "5/1/2021 3:04 PM": dt.datetime(2021, 5, 1, 15, 4), "May 1, 2021": dt.datetime(2021, 5, 1), "Nov 11, 2023": dt.datetime(2023, 11, 11),
    "13/1/2021": None, "": None, "   ": None, "nan": None, "soon": None, "12:30": None, None: None,
}
DURATIONS = {
    "24 Hours": 24, "15 Minutes": 0.25, "2 Days": 48, "2.5 hrs": 2.5, "7": 7, " 7.5 ": 7.5, "2 Weeks": None, "TBD": None,
    "": None, "unknown": None, "nan": None, "1hour 30min": 1, "10 min.": 10 / 60, "about 3 hours": None, "-3": None, None: None,
}


@pytest.mark.parametrize("cases,parse", [(DATES, parse_filing_date), (DURATIONS, parse_duration_hours)])
def test_free_text(spark, cases, parse):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", parse(F.col("t")).alias("v")).collect()}
    assert got == dict(enumerate(cases.values()))


def sheet(spark, header, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{h}` string" for h in header))


OLD = ["POTW/POSS Name", "Discharge Start Date", "Duration", "Receiving Water Body", "County", "Reason"]
API = ["facilityName", "sprtkStartDischargeDatetime", "dischargeDuration", "receivingWaterBody", "countyName", "dischargeReason"]
LOW = ["facility name", "start time", "duration", "affected water body", "county", "reasons for discharge"]


def sheets(spark):
    return {
        "2021-11": sheet(spark, OLD, ("Plant A", "11/02/2021 00:00:00", "2 Hours", "Creek", "Erie", "Rain"),
                         (None, None, None, None, None, None)),
        "2021-12": sheet(spark, OLD, (" PLANT a ", "11/2/2021", "2 hours ", "creek", "Erie", "Rain"), (None, " ", None, None, None, None)),
        "2023": sheet(spark, API, ("nycdep Tunnel", "2023-01-05 10:00:00", None, None, "Erie", "CSO"),
                      ("nycdep Tunnel", "2023-01-05 10:00:00", "", "", "Erie", "CSO")),
        "2024": sheet(spark, LOW, ("Plant B", "1/9/2024 1:30", "TBD", "Bay", " Kings ", "Pipe Break,Pipe Break")),
    }


def test_eras_meet_in_one_table(spark):
    raw = filings.union_sheets(sheets(spark))
    assert raw.columns == [*filings.ALIASES, "sheet", "row_no"] and raw.count() == 7
    assert {r["sheet"]: r["facility"] for r in raw.where("facility is not null").collect()} == {
        "2021-11": "Plant A", "2021-12": " PLANT a ", "2023": "nycdep Tunnel", "2024": "Plant B"}


def test_the_first_header_present_counts_even_if_blank(spark):
    df = sheet(spark, ["Facility Name", "facilityName"], (None, "other"))
    assert filings.normalize_sheet(df, "s").first()["facility"] is None


def test_cleaning(spark, tmp_path):
    coverage = workflows.clean_workbook(sheets(spark), str(tmp_path / "all"), str(tmp_path / "city")).first()
    assert (coverage["raw_rows"], coverage["dated_rows"], coverage["unique_rows"], coverage["city_rows"]) == (7, 5, 3, 2)
    assert coverage["unparsed_dates"] == 0 and coverage["last_start"] == dt.datetime(2024, 1, 9, 1, 30)
    every = spark.read.parquet(str(tmp_path / "all"))
    assert every.columns == filings.EXPORT
    # Blank and absent parts of the key are equal, and the last sheet's row stays.
    assert sorted(r["sheet"] for r in every.collect()) == ["2021-12", "2023", "2024"]
    assert sorted(r["facility"] for r in spark.read.parquet(str(tmp_path / "city")).collect()) == ["Plant B", "nycdep Tunnel"]


def test_the_last_row_of_a_sheet_wins(spark):
    df = sheet(spark, [*OLD, "Incident ID"], ("P", "11/2/2021", "1", "w", "", "", "5"), ("P", "11/2/2021", "1", "w", "", "", "4"))
    raw = filings.normalize_sheet(df, "s", F.when(F.col("Incident ID") == "4", 2).otherwise(1).cast("long"))
    assert filings.dedup_filings(raw).first()["incident_id"] == "4"


def crossed(spark):
    eps = spark.createDataFrame(
        [(f"w{i}", at(0), at(10)) for i in range(10)] + [("a", at(5), at(20)), ("a", at(100), at(110)), ("a", at(300), at(301))],
        "waterbody string, start timestamp, until timestamp")
    filed = spark.createDataFrame([(i, at(h)) for i, h in enumerate((0, 20, 21, 29, 30, 123.9, 124.1, 500))], "i int, start_dt timestamp")
    return filed, eps


def test_filings_against_episodes(spark):
    filed, eps = crossed(spark)
    ids = lambda df: sorted(r["i"] for r in df.collect())
    active, unmatched = ids(crosscheck.filings_active(filed, eps)), ids(crosscheck.filings_unmatched(filed, eps))
    assert active == [0, 1] and sorted(active + unmatched) == list(range(8))
    assert ids(crosscheck.filings_near_onset(filed, eps)) == [0, 1, 2, 3, 5]
    shares = crosscheck.match_shares(filed, eps).first()
    assert (shares["filings"], shares["active"], shares["near_onset"]) == (8, 2, 5)
    assert shares["active_share"] == 0.25


def test_onset_clusters(spark):
    filed, eps = crossed(spark)
    clusters = crosscheck.onset_clusters(filed, eps)
    got = sorted((hours(r[0]), hours(r[1]), r[2], r[3], r[4]) for r in clusters.collect())
    assert got == [(0, 5, 11, 11, True), (100, 100, 1, 1, True), (300, 300, 1, 1, False)]
    rates = {r["size"]: (r["clusters"], r["matched"], r["match_rate"]) for r in crosscheck.cluster_match_rates(clusters).collect()}
    assert rates == {"10+": (1, 1, 1.0), "1-2": (2, 1, 0.5)}


def test_years_without_a_side_show_zero(spark):
    filed, eps = crossed(spark)
    late = filed.unionByName(spark.createDataFrame([(9, ORIGIN.replace(year=2026))], "i int, start_dt timestamp"))
    assert sorted(map(tuple, crosscheck.yearly_compare(late, eps).collect())) == [(2024, 8, 13, 3), (2026, 1, 0, 0)]


def test_wet_weather_words(spark):
    df = spark.createDataFrame([("NYCDEP", "Heavy RAIN"), ("NYCDEP", "cso"), ("NYCDEP", None), ("Other", "rain")], "facility string, reason string")
    assert crosscheck.wet_weather_city_filings(df.withColumn("county", F.lit(None).cast("string"))).count() == 2

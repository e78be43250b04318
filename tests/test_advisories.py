from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stormline.operators import advisories, panel, params, storms
from stormline.plans import workflows
from stormline.plans.catalog import QUERIES
from tests.conftest import at, hours

STORM = "sensor_id string, start timestamp, end timestamp, depth decimal(18,4), peak decimal(12,4)"
PARAMS = "waterbody string, sensor_id string, wq_threshold_in double, wq_coeff_a double, wq_coeff_b double"


def storm(spark, *rows):
    return spark.createDataFrame([("g", at(s), at(e), Decimal(d), Decimal(p)) for s, e, d, p in rows], STORM)


def body(spark, threshold=0.3, a=37.04, b=0.62, name="w"):
    return spark.createDataFrame([(name, "g", threshold, a, b)], PARAMS)


@pytest.mark.parametrize("depth,peak,fires", [
    ("0.3", "0.05", True), ("0.2999", "0.05", False), ("0.3", "0.0499", False), ("0.3", "0.04", False)])
def test_trigger_is_inclusive(spark, depth, peak, fires):
    # 0.1 + 0.2 as doubles exceeds 0.3; the threshold is compared as a decimal.
    assert advisories.triggered(storm(spark, (0, 1, depth, peak)), body(spark, 0.1 + 0.2)).count() == int(fires)


@pytest.mark.parametrize("depth,lasts", [("2", 57), ("1", 38)])
def test_duration_is_rounded_up_and_counts_from_the_last_wet_hour(spark, depth, lasts):
    row = advisories.advisory_until(storm(spark, (0, 5, depth, "0.5")), body(spark)).first()
    assert row["hours"] == lasts and hours(row["until"]) == 5 + lasts


def test_episodes_merge_inclusively(spark):
    found = storm(spark, (0, 0, "1", "1"), (10, 10, "1", "1"), (21, 21, "1", "1"))
    got = advisories.episodes(found, body(spark, a=10.0, b=1.0)).collect()
    assert sorted((hours(r["start"]), hours(r["until"]), r["dur_hr"]) for r in got) == [(0, 20, 20.0), (21, 31, 10.0)]


def test_episodes_are_disjoint_and_cover_every_trigger(spark):
    rows = [(h, h + h % 5, str(0.3 + (h % 11) / 3), "0.5") for h in range(0, 2000, 9)]
    until = advisories.advisory_until(storm(spark, *rows), body(spark)).collect()
    merged = sorted((r["start"], r["until"]) for r in advisories.episodes(storm(spark, *rows), body(spark)).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
    assert all(any(s <= r["start"] and r["until"] <= u for s, u in merged) for r in until)


def test_summary_keeps_quiet_waterbodies_and_ranks(spark):
    dims = body(spark).unionByName(body(spark, name="dry", threshold=99.0)).unionByName(body(spark, name="also dry", threshold=99.0))
    found = storm(spark, (0, 0, "1", "1"), (500, 500, "2", "1"))
    reliable = spark.createDataFrame([("g", 8766)], "sensor_id string, reliable_hours long")
    got = advisories.waterbody_summary(dims, advisories.episodes(found, dims), reliable)
    assert [tuple(r) for r in got.collect()] == [
        ("w", "g", 0.3, 2.0, 95, 1.1, 48), ("also dry", "g", 99.0, 0.0, 0, 0.0, 0), ("dry", "g", 99.0, 0.0, 0, 0.0, 0)]
    top = advisories.burden_topk(got, 1).collect()
    assert {(r["side"], r["waterbody"]) for r in top} == {("most", "w"), ("least", "also dry")}


def test_latest_row_with_a_null_drops_the_waterbody(spark):
    log = spark.createDataFrame(
        [(at(0), "a", "g", 0.1, 1.0, 1.0), (at(1), "a", "g", None, 1.0, 1.0),
         (at(0), "b", "g", None, 1.0, 1.0), (at(1), "b", "26", 0.2, 2.0, 3.0)],
        "poll_time_utc timestamp, " + PARAMS)
    assert [tuple(r) for r in params.latest_params(log).collect()] == [("b", "26", 0.2, 2.0, 3.0)]
    assert {tuple(r) for r in params.gauge_map(log).collect()} == {("a", "g"), ("b", "26")}


def test_published_ends_meet_their_episode(spark):
    found = advisories.episodes(storm(spark, (0, 0, "1", "1")), body(spark, a=10.0, b=1.0))
    log = spark.createDataFrame(
        [(at(2), "w", at(0), 9.5), (at(1), "w", at(0), 8.0), (at(2), "w", at(10), 1.0), (at(2), "w", at(11), 1.0), (at(1), "v", at(0), 1.0)],
        "poll_time_utc timestamp, waterbody string, occurred_on timestamp, duration_hr double")
    got = {(r["waterbody"], hours(r["occurred_on"])): r["diff_hr"] for r in advisories.live_check(log, found).collect()}
    assert got == {("w", 0.0): 2.0, ("w", 10.0): -1.0, ("w", 11.0): None, ("v", 0.0): None}


def test_absence_from_a_poll_means_off(spark):
    polls = spark.createDataFrame([(at(0), "a"), (at(0), "b"), (at(1), "a")], "poll_time_utc timestamp, waterbody string")
    log = spark.createDataFrame([(at(0), "a", "WQ")], "poll_time_utc timestamp, waterbody string, advisory_type string")
    got = advisories.observed_status(polls, log)
    assert got.count() == 6
    on = got.where("on_advisory").collect()
    assert [(hours(r[0]), r[1], r[2]) for r in on] == [(0, "a", "WQ")]


def readings(spark):
    rows = []
    for g in ("p", "q", "r"):
        for h in range(24 * 80):
            rain = 0.4 if h % 97 in (0, 1, 5) and not (g == "r" and 300 < h < 1200) else 0.0
            rows.append((f"{g}-{h}", g, at(h), Decimal(str(9 if (g, h) == ("q", 50) else rain))))
    return spark.createDataFrame(rows, "id string, sensor_id string, occurred_on timestamp, precip_in decimal(12,4)")


def polls(spark):
    return spark.createDataFrame([(at(0), f"W{g}", g, 0.5, 12.3, 0.6) for g in "pqr"], "poll_time_utc timestamp, " + PARAMS)


def test_reconstruction_end_to_end(spark, tmp_path):
    summary, found = workflows.reconstruct(readings(spark), polls(spark))
    rows = {r["waterbody"]: r for r in summary.collect()}
    # The dead gauge lost its silent month; the single spike raised no episode anywhere.
    assert rows["Wr"]["episodes_per_yr"] <= rows["Wp"]["episodes_per_yr"]
    assert found.where("waterbody = 'Wq'").count() == found.where("waterbody = 'Wp'").count() == 20
    for form in ("parquet", "csv"):
        out, eps = str(tmp_path / f"s-{form}"), str(tmp_path / f"e-{form}")
        workflows.write_reconstruction(spark, readings(spark), polls(spark), out, eps, form=form)
        back = spark.read.option("header", True).csv(out) if form == "csv" else spark.read.parquet(out)
        assert {r["waterbody"]: float(r["pct_time"]) for r in back.collect()} == {k: r["pct_time"] for k, r in rows.items()}


def test_masked_hours_are_not_reliable(spark):
    grid = panel.panel_grid(panel.dedup_hours(readings(spark)))
    controlled = panel.quality_control(grid)
    kept = {r[0]: r[1] for r in panel.reliable_hours(controlled).collect()}
    assert kept["p"] == kept["q"] == 24 * 80 and kept["r"] < 24 * 80
    assert storms.storms(controlled).where(F.col("depth") > 5).count() == 0


@pytest.fixture(scope="module")
def low_tables(spark, tmp_path_factory):
    """A gauge of 0.3 inch and its waterbody, whose threshold of 0.1 is met and whose coefficient is 40 whole hours."""
    folder = str(tmp_path_factory.mktemp("low"))
    events = [(1, at(0), 7, "click", 30.0), (2, at(9), 7, "error", 0.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(
        f"{folder}/events.parquet")
    line = [(1, 1, 7, at(0), 500.0, 0.1, 40.0, 0.5)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, "
                                "l_tax double, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_triggered_query_keeps_storms_over_a_tenth_per_line(spark, low_tables):
    assert [r["depth"] for r in QUERIES["triggered"](spark, low_tables).collect()] == [0.3]


def test_advisory_until_query_uses_whole_coefficients(spark, low_tables):
    # ceil(40 * 0.3 ** 1.0)
    assert [r["hours"] for r in QUERIES["advisory_until"](spark, low_tables).collect()] == [12]


def test_live_check_query_finds_the_long_episode(spark, low_tables):
    assert [r["episode_until"] for r in QUERIES["live_check"](spark, low_tables).collect()] == ["2024-01-01 12:00:00"]

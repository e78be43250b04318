from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from pyspark.sql import Observation

from stormline.operators import params
from stormline.schemas import WATERBODY_OBJECT
from stormline.sources import ledger, payloads, readers, writers
from tests.conftest import at, hours


def polls(spark, *docs):
    return spark.createDataFrame([(at(0), json.dumps(d) if not isinstance(d, str) else d) for d in docs], "poll_time_utc timestamp, payload string")


def test_gauge_is_the_file_name(spark, tmp_path):
    (tmp_path / "26.csv").write_text("id,sensor_id,occurred_on,precip_in\n1,other,2024-01-01T00:00:00,0.01\n2,other,2024-01-01T01:00:00,\n")
    (tmp_path / "BB.csv").write_text("id,sensor_id,occurred_on,precip_in\n3,BB,2024-01-01T00:00:00,1.25\n")
    (tmp_path / "_meta.json").write_text(json.dumps({"26": {"complete": True, "records": 2, "updated": "2024-01-02T00:00:00Z"}}))
    got = sorted(tuple(r) for r in readers.gauge_history(spark, str(tmp_path)).collect())
    assert got == [("1", "26", dt.datetime(2024, 1, 1), Decimal("0.0100")), ("2", "26", dt.datetime(2024, 1, 1, 1), None),
                   ("3", "BB", dt.datetime(2024, 1, 1), Decimal("1.2500"))]
    state = readers.completeness_state(spark, str(tmp_path / "_meta.json")).first()
    assert (state["sensor_id"], state["complete"], state["records"]) == ("26", True, 2)


def test_logs_are_read_as_one(spark, tmp_path):
    head = "poll_time_utc,waterbody,wbid,sensor_id,rain_24h_in,wq_threshold_in,wq_coeff_a,wq_coeff_b,cso_threshold_in,provisional_on_advisory\n"
    (tmp_path / "waterbody_log_2026-06.csv").write_text(head + '2026-06-01T00:00:00Z,"Creek, Upper",1,26,0.1,0.2,3,0.5,0.1,False\n')
    (tmp_path / "waterbody_log_2026-07.csv").write_text(head + '2026-07-01T00:00:00Z,"Creek, Upper",1,26,0.3,0.2,4,0.5,0.1,True\n')
    log = readers.waterbody_log(spark, str(tmp_path / "waterbody_log_*.csv"))
    assert [tuple(r) for r in params.latest_params(log).collect()] == [("Creek, Upper", "26", 0.2, 4.0, 0.5)]
    (tmp_path / "sensor_log_2026-07.csv").write_text("poll_time_utc,sensor_id,sensor_name,rain_24h_in,active\n2026-07-01T00:00:00Z,26,x,0.5,True\n")
    assert readers.sensor_log(spark, str(tmp_path / "sensor_log_*.csv")).first()["active"] is True
    (tmp_path / "advisory_log_2026-07.csv").write_text(
        "poll_time_utc,advisory_type,waterbody,wb_api_id,wb_class,rain_gauge,occurred_on,duration_hr,volume\n2026-07-01T00:00:00Z,CSO,w,1,I,26,2026-07-01T00:00:00,5,\n")
    row = readers.advisory_log(spark, str(tmp_path / "advisory_log_*.csv")).first()
    assert row["duration_hr"] == 5 and row["volume"] is None


def test_model_config(spark, tmp_path):
    doc = [{"name": "w", "wbid": 3, "advisoryTypes": [{"shortName": "CSO", "rainfallThreshold": 0.1, "coefficients": [1, 0, 0, 0, 0, 2.5]}]}, {"name": "v"}]
    (tmp_path / "latest.json").write_text(json.dumps(doc, indent=1))
    config = readers.model_config(spark, str(tmp_path / "latest.json"))
    assert config.count() == 2
    assert [tuple(r) for r in params.cso_params(config).collect()] == [("w", 1, 0, 0, 0, 0, 2.5)]


def test_legacy_layer_nulls_the_missing_date(spark, tmp_path):
    attributes = {"Waterbod_1": "Creek ", "Prim_RainG": "Bay", **{f"{c}_Curve": 0.5 for c in "ABCDEF"}, "Rainfall_T": 0.1, "peak_inten": 0.05,
                  "manual_ove": 0, "WBID": 36, "Advisory": 1, "Expires": -62135596800000, "Hours": 1.5, "Creation_1": 1554336000000,
                  "EditDate_1": 1554336000000, "Creator_1": "someone"}
    (tmp_path / "layer.json").write_text(json.dumps({"features": [{"attributes": attributes}]}))
    row = readers.legacy_layer(spark, str(tmp_path / "layer.json")).first()
    assert (row["wbid"], row["waterbody"], row["expires"], row["created"]) == (36, "Creek", None, dt.datetime(2019, 4, 4))
    assert "someone" not in map(str, row)


def test_waterbody_payload(spark):
    full = {"name": "a", "wbid": 1, "activeSensor": {"id": "26", "accumulatedLast24Hours": 0.50005},
            "advisoryTypes": [{"shortName": "CSO", "rainfallThreshold": 0.1}, {"shortName": "WQ", "rainfallThreshold": 0.5, "coefficients": [3]}]}
    bare = {"name": "b", "wbid": 2, "advisoryTypes": None}
    got = {r["waterbody"]: tuple(r)[2:] for r in payloads.waterbody_rows(polls(spark, [full, bare])).collect()}
    assert got == {"a": (1, "26", round(0.50005, 4), 0.5, 3.0, None, 0.1, True), "b": (2, None, 0.0, None, None, None, None, False)}


def test_sensor_and_advisory_payloads(spark):
    row = payloads.sensor_rows(polls(spark, [{"id": "g", "name": "G", "accumulatedLast24Hours": None, "active": True}])).first()
    assert tuple(row)[1:] == ("g", "G", 0.0, True)
    one = {"waterbody": {"id": 7, "name": "w", "class": "I"}, "occurredOn": "2024-01-01T02:00:00Z", "duration": 3.5}
    got = payloads.all_advisory_rows(polls(spark, [one]), polls(spark, [])).first()
    assert (got["advisory_type"], got["wb_api_id"], got["rain_gauge"], hours(got["occurred_on"]), got["volume"]) == ("WQ", "7", None, 2.0, None)


def test_one_bad_entry_costs_itself_only(spark):
    df = polls(spark, [7, {"name": "a", "wbid": 1}, None, [1], {"name": "b", "wbid": "x"}], {"error": "gone"}, '  [{"name": "c"}]', "[{]")
    assert sorted((r["waterbody"], r["wbid"]) for r in payloads.waterbody_rows(df).collect()) == [("a", 1), ("b", None), ("c", None)]


@pytest.mark.parametrize("page,found", [
    ([{"id": 1}, 5, {"id": "x"}], ["1", "x"]), ({"results": [{"id": 1.5, "sensorId": "g", "occurredOn": "t"}]}, ["g-t"]),
    ({"items": 3, "values": [{"id": True}, {"id": None}]}, ["True", "None-None"]), ({"other": [{"id": 1}]}, []), ("not json", []), ([], []),
])
def test_record_lists(spark, page, found):
    df = spark.createDataFrame([(page if isinstance(page, str) else json.dumps(page),)], "payload string")
    assert [r["id"] for r in payloads.sample_rows(df).collect()] == found


def test_a_batch_of_a_monthly_log_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(at(0), "a"), (at(24 * 40), "b")], "poll_time_utc timestamp, waterbody string")
    path = str(tmp_path / "log")
    assert writers.read_monthly(spark, path, rows.schema).count() == 0
    for batch, run in ((0, "x"), (1, "x"), (0, "x"), (0, "y")):
        writers.append_monthly(rows, path, batch, run)
    log = writers.read_monthly(spark, path, rows.schema)
    assert log.count() == 6 and log.where("poll_month = '2024-02'").count() == 3
    assert log.columns == ["poll_time_utc", "waterbody", "poll_month"]
    plan = log.where("poll_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(poll_month" in plan


def test_a_batch_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    path = str(tmp_path / "log")
    ledger.append_batch(rows, path, 0)
    wanted = ledger._replace

    def breaks(frame, target, by):
        if target.endswith(".marks"):
            raise RuntimeError("lost")
        wanted(frame, target, by)

    monkeypatch.setattr(ledger, "_replace", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        ledger.append_batch(rows, path, 1)
    assert sorted(r["n"] for r in ledger.read_batches(spark, path, rows.schema).collect()) == [1, 2]
    monkeypatch.undo()
    ledger.append_batch(rows.where("n = 1"), path, 1)
    found = ledger.read_batches(spark, path, rows.schema)
    assert sorted((r["n"], r["run"], r["batch"]) for r in found.collect()) == [(1, "0", 0), (1, "0", 1), (2, "0", 0)]
    assert ledger.read_batches(spark, path, rows.schema, before=1).count() == 2
    ledger.append_batch(rows.where("n > 9"), path, 2)
    assert found.count() == 3 and ledger.committed(spark, path).count() == 3


def test_polls_that_cannot_be_read_are_counted(spark):
    good, object_ = [{"name": "a", "wbid": 1}], {"name": "a"}
    df = polls(spark, good, "", "[{", object_, [], [1, *good], [{"wbid": "x"}], good, "[]").unionByName(
        spark.createDataFrame([(at(5), None)], "poll_time_utc timestamp, payload string"))
    got = {r["state"]: (r["polls"], hours(r["last_poll"])) for r in payloads.poll_quality(df, WATERBODY_OBJECT).collect()}
    assert got == {"read": (2, 0), "unparsed": (2, 0), "not a list": (1, 0), "empty": (2, 0), "partly read": (2, 0), "missing": (1, 5)}
    seen = Observation("polls")
    assert payloads.waterbody_rows(payloads.watched(df, WATERBODY_OBJECT, seen)).where("waterbody is not null").count() > 0
    assert seen.get == {"polls": 10, "missing": 1, "unparsed": 2, "not_a_list": 1, "partly_read": 2}


def test_history_is_sorted_in_a_new_version(spark, tmp_path):
    rows = spark.createDataFrame([("2", "b", at(1)), ("1", "a", at(5)), ("3", "a", at(2))], "id string, sensor_id string, occurred_on timestamp")
    path = str(tmp_path / "v1")
    writers.write_history(rows, path)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["3", "1", "2"] or spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="exist"):
        writers.write_history(rows, path)


def test_filing_sheet_keeps_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Facility Name,Reason\n"A ""x""","two\nlines"\n')
    assert readers.filing_sheet(spark, str(tmp_path / "s.csv")).count() == 1


def test_watched_polls_are_parsed_once(spark):
    df = spark.createDataFrame([(at(0), "[{}]")], "poll_time_utc timestamp, payload string")
    plan = payloads.watched(df, WATERBODY_OBJECT, "polls")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F

from stormline.operators import ingest, params
from tests.conftest import at, hours

READING = "id string, sensor_id string, occurred_on timestamp, precip_in decimal(12,4)"


def reading(spark, *rows):
    return spark.createDataFrame([(i, s, at(h), Decimal(str(p))) for i, s, h, p in rows], READING)


def config(**changed):
    base = {"name": "w", "wbid": 1, "createdOn": "x", "$type": "T", "activeSensor": {"id": "g", "note": "a, {b}"},
            "advisoryTypes": [{"shortName": "CSO", "rainfallThreshold": 0.1, "coefficients": [1, 2, 3, 4, 5, 6]}]}
    return {**base, **changed}


def changes(spark, docs):
    df = spark.createDataFrame([("k", at(i), d) for i, d in enumerate(docs)], "config_key string, poll_time_utc timestamp, payload string")
    return sorted(hours(r["poll_time_utc"]) for r in params.config_changes(df, ["config_key"]).collect())


def test_config_is_saved_only_when_it_changed(spark):
    one = config()
    reordered = json.dumps(dict(reversed(list(config(createdOn="later", activeSensor={"id": "h"}).items()))))
    edited = config(advisoryTypes=[{"shortName": "CSO", "rainfallThreshold": 0.1, "coefficients": [1, 2, 3, 4, 5, 7]}])
    docs = [json.dumps(one), reordered, json.dumps(one, indent=1), json.dumps(edited), json.dumps(edited), json.dumps(one)]
    assert changes(spark, docs) == [0, 3, 5]


def test_the_whole_document_counts_less_volatile_keys_at_any_depth(spark):
    deep = lambda n, when: {"notes": [{"list": [{"activeSensor": {"a": [{"b": when}]}, "createdOn": when, "n": n}]}]}
    docs = [config(), config(extra=1), config(extra=1, createdOn=None), config(extra=1, **deep(1, "x")),
            config(extra=1, **deep(1, [1, {"y": 2}])), config(extra=1, **deep(2, "x")),
            {k: v for k, v in config(extra=1, **deep(2, "z")).items() if k not in params.VOLATILE_KEYS}, config(extra=1.0, **deep(2, "z"))]
    assert changes(spark, [json.dumps(d) for d in docs]) == [0, 1, 3, 5, 7]


def test_text_that_is_no_document_is_passed_over(spark):
    one = json.dumps(config())
    assert changes(spark, [one, "{", None, "", one, "[" * 100_000, json.dumps(config(wbid=2))]) == [0, 6]


def test_changes_never_repeat_a_hash(spark):
    docs = [json.dumps(config(wbid=i // 3 % 2)) for i in range(40)]
    df = spark.createDataFrame([("k", at(24 * i), d) for i, d in enumerate(docs)], "config_key string, poll_time_utc timestamp, payload string")
    hashes = [r["config_hash"] for r in params.config_changes(df, ["config_key"]).orderBy("poll_time_utc").collect()]
    assert len(hashes) == 14 and all(a != b for a, b in zip(hashes, hashes[1:]))


def test_overflow_curves(spark):
    types = "name string, advisoryTypes array<struct<shortName:string,rainfallThreshold:double,coefficients:array<double>>>"
    df = spark.createDataFrame([
        ("live", [("WQ", 0.1, [9.0]), ("CSO", 0.1, [0.0, 0.0, 0.0, 0.0, 0.0, 6.0]), ("CSO", 0.1, [7.0] * 6)]),
        ("zero", [("CSO", 0.1, [0.0] * 6)]), ("short", [("CSO", 0.1, [1.0])]), ("empty", []), ("none", None),
        ("null", [("CSO", 0.1, None)])], types)
    got = {r["waterbody"]: tuple(r)[1:] for r in params.cso_params(df).collect()}
    assert got == {"live": (0, 0, 0, 0, 0, 6), "short": (1, None, None, None, None, None)}


def test_drift_counts_nulls_as_values(spark):
    cols = "wbid int, a double, b double, c double, d double, e double, f double"
    old = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, None, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    new = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, None, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0, 1.0, None)], cols)
    drift = params.param_drift(old, new)
    assert {r["wbid"]: r["changed"] for r in drift.collect()} == {1: False, 2: False, 3: True}
    assert tuple(params.drift_counts(drift).first()) == (3, 1, 1, 1)


def test_record_key_falls_back_to_gauge_and_time(spark):
    df = spark.createDataFrame([("7", "g", "t"), (None, "g", "t"), (None, None, "t")], "id string, s string, o string")
    assert [r[0] for r in df.select(ingest.record_key(F.col("id"), F.col("s"), F.col("o"))).collect()] == ["7", "g-t", "None-t"]


def test_first_seen_wins_and_merging_is_idempotent(spark):
    history = reading(spark, ("1", "g", 0, 1))
    batch = reading(spark, ("1", "g", 0, 9), ("2", "g", 1, 2), ("2", "g", 1, 3), ("3", "h", 1, 4))
    merged = ingest.history_merge(history, batch, "id", ["occurred_on", "precip_in"])
    assert sorted((r["id"], int(r["precip_in"])) for r in merged.collect()) == [("1", 1), ("2", 2), ("3", 4)]
    again = ingest.history_merge(merged, batch, "id", ["occurred_on", "precip_in"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    fresh = {r["sensor_id"]: (r["fresh"], r["caught_up"]) for r in ingest.fresh_counts(history, batch).collect()}
    assert fresh == {"g": (1, False), "h": (1, False)}
    assert {r["caught_up"] for r in ingest.fresh_counts(merged, batch).collect()} == {True}


def test_completeness_is_sticky(spark):
    merged = reading(spark, ("1", "a", 0, 1), ("2", "a", 5, 1), ("3", "b", 0, 1), ("4", "c", 0, 1))
    prior = spark.createDataFrame([("a", True), ("b", False)], "sensor_id string, complete boolean")
    ended = spark.createDataFrame([("c",)], "sensor_id string")
    state = ingest.completeness(merged, prior, ended, F.lit("2024-02-01").cast("timestamp"))
    assert {r["sensor_id"]: (r["complete"], r["records"], hours(r["latest"])) for r in state.collect()} == {
        "a": (True, 2, 5.0), "b": (False, 1, 0.0), "c": (True, 1, 0.0)}
    sensors = spark.createDataFrame([("a",), ("b",), ("z",)], "sensor_id string")
    assert [r["sensor_id"] for r in ingest.backfill_order(sensors, state).collect()] == ["b", "z", "a"]
    assert tuple(ingest.progress(state).first()) == (2, 3)


def test_gaps_in_hours(spark):
    df = spark.createDataFrame([("a", at(h)) for h in (0, 1, 4, 800, 801)] + [("b", at(900))], "sensor_id string, hour timestamp")
    got = sorted((r["sensor_id"], hours(r["from_hour"]), hours(r["to_hour"]), r["step_hours"]) for r in ingest.continuity_gaps(df).collect())
    assert got == [("a", 1, 4, 3), ("a", 4, 800, 796)]


def test_config_texts_are_parsed_once(spark):
    df = spark.createDataFrame([("w", at(0), "{}")], "config_key string, poll_time_utc timestamp, payload string").repartition(2)
    plan = params.config_changes(df, ["config_key"])._jdf.queryExecution().executedPlan().toString()
    # One in each of the two parts that read the same shuffle.
    assert plan.count("ArrowEvalPython") == 2


def test_volatile_keys_go_at_every_depth():
    one = '{"a": [{"createdOn": 1, "b": {"$type": 2, "c": 3}}], "activeSensor": {"x": 1}}'
    assert params._digest(one) == params._digest('{"a":[{"b":{"c":3}}]}') != params._digest('{"a":[{"b":{"c":4}}]}')
    assert params._digest("{") is None and params._digest(None) is None

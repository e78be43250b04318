from __future__ import annotations

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from stormline.functions.clock import HOUR
from stormline.operators import params, storms
from stormline.operators.panel import dedup_hours
from stormline.plans import adapters as A
from stormline.streaming import history, polls
from stormline.streaming.cells import PROVIDER
from stormline.streaming.config import current_changes, keep_config_changes
from stormline.streaming.storms import StormCells, current_storms, keep_storms
from tests.conftest import at, hours

READING = "id string, sensor_id string, occurred_on timestamp, precip_in decimal(12,4)"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_polls_land_in_monthly_logs(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def drop(name, stamp, body):
        (landing / name).write_text(json.dumps({"poll_time_utc": stamp, "payload": json.dumps(body)}) + "\n")

    def run():
        polls.append_log(polls.landed_polls(spark, str(landing)), "sensors", str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "log"))

    drop("1.json", "2024-01-31T23:50:00Z", [{"id": "a"}, {"id": "b"}])
    assert run().count() == 2
    drop("2.json", "2024-02-01T00:10:00Z", [{"id": "a", "accumulatedLast24Hours": 0.5}])
    log = run()
    assert log.count() == 3 and log.where("poll_month = '2024-02'").first()["rain_24h_in"] == 0.5


def test_landed_polls_are_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(polls, "POLLS_A_FILE", 40)
    body = json.dumps([{"name": "WB1", "wbid": 1, "notes": "as before " * 50}])
    rows = [(at(i), None if i % 9 == 0 else body[:60] if i % 9 == 1 else body) for i in range(300)]
    polls.land_polls(spark.createDataFrame(rows, "poll_time_utc timestamp, payload string").coalesce(1), str(tmp_path / "in"))
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) >= 7 and sum(f.stat().st_size for f in files) < sum(len(p or "") for _, p in rows) / 5
    read = spark.read.schema(polls.POLLS).json(str(tmp_path / "in"))
    assert sorted((r["poll_time_utc"], r["payload"] or "") for r in read.collect()) == [(t, p or "") for t, p in rows]
    polls.append_log(polls.landed_polls(spark, str(tmp_path / "in")), "waterbodies", str(tmp_path / "log"), str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == sum(p == body for _, p in rows)


def feed(spark, folder, schema, batches, start):
    """Each batch lands as a file of its own and is taken by a run of its own."""
    for rows in batches:
        land(spark, folder / "in", rows, schema)
        start(spark.readStream.schema(schema).parquet(str(folder / "in"))).awaitTermination()


def test_history_gains_each_key_once(spark, tmp_path):
    path, state = str(tmp_path / "history"), str(tmp_path / "state")
    schema = spark.createDataFrame([], READING).schema
    saved = lambda: sorted((r["id"], int(r["precip_in"])) for r in history.read_history(spark, path, schema).collect())
    start = lambda checkpoint: lambda stream: history.keep_history(stream, path, checkpoint, buckets=8, parts=1)
    assert saved() == []
    feed(spark, tmp_path, READING, [[("1", "g", at(0), Decimal(1)), ("2", "g", at(1), Decimal(2)), ("2", "g", at(1), Decimal(3))]], start(state))
    assert saved() == [("1", 1), ("2", 2)]
    feed(spark, tmp_path, READING, [[("1", "g", at(0), Decimal(9)), ("3", "g", at(2), Decimal(4)), (None, "g", at(2), Decimal(4))]], start(state))
    assert saved() == [("1", 1), ("2", 2), ("3", 4)]
    # The samples of a month later, one of them under a known id.
    feed(spark, tmp_path, READING, [[("3", "g", at(900), Decimal(7)), ("4", "g", at(900), Decimal(8))]], start(state))
    assert saved() == [("1", 1), ("2", 2), ("3", 4), ("4", 8)]


def test_new_samples_read_nothing_of_the_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    rows = lambda low, high: [(f"k{i}", "g", at(i), Decimal(1)) for i in range(low, high)]
    asked = []
    wanted = history.saved_keys
    monkeypatch.setattr(history, "saved_keys", lambda s, p, buckets, n: (asked.append(sorted(buckets)), wanted(s, p, buckets, n))[1])
    start = lambda stream: history.keep_history(stream, path, str(tmp_path / "state"), buckets=16)
    feed(spark, tmp_path, READING, [rows(0, 400), rows(400, 800), rows(800, 1200)], start)
    assert asked == [[], [], []]
    feed(spark, tmp_path, READING, [rows(1200, 1300) + rows(7, 8)], start)
    one = spark.createDataFrame([("k7",)], "id string").select(history.bucket_of("id", 16)).first()[0]
    assert asked[-1] == [one]
    plan = wanted(spark, path, [one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(bucket#" in plan and "ReadSchema: struct<id:string>" in plan
    assert history.read_history(spark, path, spark.createDataFrame([], READING).schema).count() == 1300


def test_filters_know_every_key_they_were_given(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id")).withColumn("bucket", history.bucket_of("id", 4))
    blooms = history.bloom_rows(keys, 2)
    assert history.suspects(keys, blooms, 2).count() == 5000
    others = spark.range(5000, 15000).select(F.concat(F.lit("k"), "id").alias("id")).withColumn("bucket", history.bucket_of("id", 4))
    assert history.suspects(others, blooms, 2).count() < 100


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    land(spark, tmp_path / "in", [("1", "g", at(0), Decimal(1)), ("1", "g", at(0), Decimal(1)), ("2", "g", at(1), Decimal(1))], READING)
    stream = polls.dedup_samples(spark.readStream.schema(READING).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(
        availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


STORM_READING = "id string, sensor_id string, hour timestamp, precip decimal(12,4)"


def random_readings(seed):
    rng = random.Random(seed)
    rows = [(f"{rng.randint(0, 10 ** 6):07d}", rng.choice("abc"), at(rng.randint(0, 1500)), Decimal(rng.choice([0, 0, 1, 3])) / 4)
            for _ in range(500)]
    rows += [(f"x{i}", s, t, p + 1) for i, (_, s, t, p) in enumerate(rows[::7])]  # repeats that lose
    rows += [(f"!{i}", s, t, Decimal(i % 2)) for i, (_, s, t, _) in enumerate(rows[::5])]  # repeats that win, dry ones among them
    return rows


@pytest.mark.parametrize("order", ["newest first", "oldest first", "shuffled"])
def test_streamed_storms_equal_batch_storms(spark, tmp_path, order):
    rows = random_readings(3)
    rows.sort(key=lambda r: r[2], reverse=order == "newest first")
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    rows += [(None, "a", at(3), Decimal(1)), ("y", None, at(3), Decimal(1)), ("z", "a", None, Decimal(1)), ("0", "d", at(1), None)]
    step = len(rows) // 3 + 1
    before = spark.conf.get(PROVIDER)
    feed(spark, tmp_path, STORM_READING, [rows[i:i + step] for i in range(0, len(rows), step)] + [rows[:20]],
         lambda stream: keep_storms(stream, str(tmp_path / "out"), str(tmp_path / "s")))
    assert spark.conf.get(PROVIDER) == before
    key = lambda r: (r["sensor_id"], hours(r["start"]), hours(r["end"]), r["depth"], r["peak"])
    good = spark.createDataFrame(rows, STORM_READING).dropna("any", subset=["id", "sensor_id", "hour"])
    batch = storms.storms(dedup_hours(good.select("id", "sensor_id", F.col("hour").alias("occurred_on"), F.col("precip").alias("precip_in"))))
    expected = sorted(map(key, batch.collect()))
    assert sorted(map(key, current_storms(spark, str(tmp_path / "out")).collect())) == expected and len(expected) > 50


def test_a_late_reading_joins_two_storms(spark, tmp_path):
    out = str(tmp_path / "out")
    start = lambda stream: keep_storms(stream, out, str(tmp_path / "s"), cell_length=24 * 3_600_000_000)
    found = lambda: sorted((hours(r["start"]), hours(r["end"]), r["depth"]) for r in current_storms(spark, out).collect())
    feed(spark, tmp_path, STORM_READING, [[("1", "a", at(20), Decimal(1)), ("2", "a", at(30), Decimal(2))]], start)
    assert found() == [(20, 20, 1), (30, 30, 2)]
    feed(spark, tmp_path, STORM_READING, [[("3", "a", at(25), Decimal(4))]], start)
    assert found() == [(20, 30, 7)]
    feed(spark, tmp_path, STORM_READING, [[("0", "a", at(25), Decimal(0))]], start)
    assert found() == [(20, 20, 1), (30, 30, 2)]


def test_state_over_batches(spark, tmp_path):
    schema = "waterbody string, poll_time_utc timestamp, duration_hr double"
    out, keys, order = str(tmp_path / "out"), ["waterbody"], ["poll_time_utc"]
    start = lambda stream: polls.keep_state(stream, keys, order, out, str(tmp_path / "s"))

    def state():
        rows = polls.current_state(spark, out, keys, order, spark.createDataFrame([], schema).schema)
        return {r["waterbody"]: (hours(r["poll_time_utc"]), r["duration_hr"]) for r in rows.collect()}

    assert state() == {}
    feed(spark, tmp_path, schema, [[("a", at(1), 1.0), ("a", at(3), 3.0), ("b", at(1), 1.0)]], start)
    assert state() == {"a": (3, 3.0), "b": (1, 1.0)}
    feed(spark, tmp_path, schema, [[("a", at(2), 2.0), ("b", at(5), 5.0), ("c", at(0), None)]], start)
    assert state() == {"a": (3, 3.0), "b": (5, 5.0), "c": (0, None)}
    # A log that only grows by what was touched: the late row of a is in the batch, c isn't in the first.
    logged = spark.read.parquet(out).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in logged} == {0: 2, 1: 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_config_changes_equal_batch_ones(spark, tmp_path, seed):
    schema = "config_key string, poll_time_utc timestamp, poll_id long, payload string"
    rng = random.Random(seed)
    doc = lambda n: json.dumps({"createdOn": rng.random(), "wbid": n, "deep": [{"activeSensor": {"x": [rng.random()]}, "n": n}]})
    rows = [(rng.choice("kl"), at(rng.randint(0, 24 * 400)), i, doc(rng.randint(0, 2))) for i in range(120)]
    rows += [rows[0], ("k", at(5), 900, "{"), ("k", at(6), 901, None), ("m", at(5), 902, doc(1))]
    feed(spark, tmp_path, schema, [rows[:50], rows[50:51], rows[51:]],
         lambda stream: keep_config_changes(stream, str(tmp_path / "out"), str(tmp_path / "s")))
    key = lambda r: (r["config_key"], hours(r["poll_time_utc"]), r["poll_id"], r["config_hash"])
    batch = params.config_changes(spark.createDataFrame(rows, schema), ["config_key"], ["poll_id"])
    assert sorted(map(key, current_changes(spark, str(tmp_path / "out")).collect())) == sorted(map(key, batch.collect()))


def test_config_stream_follows_late_snapshots(spark, tmp_path):
    schema = "config_key string, poll_time_utc timestamp, poll_id long, payload string"
    doc = lambda n, extra="": json.dumps({"createdOn": extra, "wbid": n})
    out = str(tmp_path / "out")
    start = lambda stream: keep_config_changes(stream, out, str(tmp_path / "s"))
    found = lambda: sorted(hours(r["poll_time_utc"]) for r in current_changes(spark, out).collect())
    feed(spark, tmp_path, schema, [[("k", at(0), 1, doc(1)), ("k", at(10), 2, doc(1, "x")), ("k", at(20), 3, doc(2))]], start)
    assert found() == [0, 20]
    feed(spark, tmp_path, schema, [[("k", at(5), 4, doc(2, "y"))]], start)
    assert found() == [0, 5, 10, 20]
    feed(spark, tmp_path, schema, [[("k", at(15), 5, doc(2))]], start)
    assert found() == [0, 5, 10, 15]


def test_landed_files_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS_A_FILE", 50)
    rows = spark.range(1000).select(F.timestamp_seconds("id").alias("t"), "id")
    arriving, folder = A.landed(rows, "t")
    files = [r["count"] for r in spark.read.parquet(f"{folder}/in").groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 1000 and max(files) < 150
    done = arriving.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c").start()
    done.awaitTermination()
    assert len([p for p in done.recentProgress if p.numInputRows]) == 4


def test_texts_are_made_where_they_land(spark):
    rows = spark.range(400).select(F.timestamp_seconds("id").alias("t"), "id")
    text = lambda placed: placed.select("t", F.repeat(F.lit("configuration "), 200).alias("payload"), F.spark_partition_id().alias("part"))
    arriving, folder = A.landed(rows, "t", build=text)
    found = spark.read.parquet(f"{folder}/in")
    assert arriving.schema == found.schema and found.count() == 400
    # Each text is made in the task of its file, after the rows were dealt out by time.
    files = found.groupBy(F.input_file_name()).agg(F.countDistinct("part").alias("parts"), F.min("t"), F.max("t")).collect()
    assert len(files) == 4 and all(r["parts"] == 1 for r in files)
    assert found.select("part").distinct().count() == 4


class FakeList(list):
    calls = 0

    def get(self):
        return iter(list(self))

    def appendList(self, rows):
        self.calls += 1
        self.extend(rows)

    def put(self, rows):
        self.calls += 1
        self[:] = rows


def test_a_cell_writes_its_state_once_a_micro_batch():
    cell, state = StormCells(6 * HOUR), FakeList()
    cell._held = state
    rows = [Row(at=h * HOUR, id="b", precip=Decimal(1)) for h in range(100)]
    assert len(list(cell.handleInputRows(("g", 0), iter(rows), None))) == 1 and state.calls == 1
    assert not list(cell.handleInputRows(("g", 0), iter(rows), None)) and state.calls == 1
    smaller = [Row(at=0, id="a", precip=Decimal(5))]
    [out] = cell.handleInputRows(("g", 0), iter(smaller), None)
    assert state.calls == 2 and len(state) == 100 and out["pieces"][0]["peak"] == 5

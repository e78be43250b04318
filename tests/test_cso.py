from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormline.operators import cso
from stormline.plans import workflows
from stormline.sources import writers
from tests.conftest import at, hours

CURVE = "waterbody string, a double, b double, c double, d double, e double, f double"
STATE = "waterbody string, occurred_on timestamp, depth double, peak double, volume double"


def test_observations_keep_the_earliest_poll(spark):
    log = spark.createDataFrame(
        [(at(2), "CSO", "w", at(0), 5.0), (at(1), "CSO", "w", at(0), 4.0), (at(0), "CSO", "w", at(0), 0.0),
         (at(0), "WQ", "w", at(0), 9.0), (at(0), "CSO", "v", at(0), None)],
        "poll_time_utc timestamp, advisory_type string, waterbody string, occurred_on timestamp, volume double")
    assert [(r[0], hours(r[1]), r[2]) for r in cso.cso_observations(log).collect()] == [("w", 0.0, 4.0)]


def test_formulas(spark):
    states = spark.createDataFrame([("w", at(0), 2.0, 3.0, 1.0)], STATE)
    curves = spark.createDataFrame([("w", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], CURVE)
    row = cso.predictions(states, curves).first()
    assert row["pred_quadratic_depth_peak"] == 1 + 4 + 12 + 12 + 45 + 36
    assert row["pred_poly5_depth"] == 1 + 4 + 12 + 32 + 80 + 192
    assert cso.estimates(cso.predictions(states, curves)).first()["d"] == 4.0


def test_scores(spark):
    rows = [("a", 10.0, 12.0, 10.0), ("b", 20.0, 20.0, 25.0), ("b", 30.0, 27.0, 30.0)]
    df = spark.createDataFrame(rows, "waterbody string, volume double, pred_quadratic_depth_peak double, pred_poly5_depth double")
    assert tuple(cso.scores(df).first()) == (3, 2, round(1 - 13 / 200, 4), round((13 / 3) ** 0.5, 4), round(1 - 25 / 200, 4), round((25 / 3) ** 0.5, 4))
    constant = df.withColumn("volume", F.lit(4.0))
    assert cso.scores(constant).first()["poly5_depth_r2"] is None


def points(n, name, rng):
    return [(name, at(i), rng.uniform(0, 3), rng.uniform(0, 1), rng.uniform(0, 500)) for i in range(n)]


def test_refit_equals_direct_least_squares(spark):
    rng = random.Random(5)
    rows = points(7, "seven", rng) + points(6, "six", rng) + points(60, "many", rng)
    rows += [("flat", at(i), 1.0, 0.5, float(i)) for i in range(9)]
    got = {(r["waterbody"], r["shape"]): r for r in cso.refit(spark.createDataFrame(rows, STATE)).collect()}
    assert {k[0] for k in got} == {"seven", "many", "flat"}
    for (name, shape), r in got.items():
        d, k, y = (np.array([x[i] for x in rows if x[0] == name]) for i in (2, 3, 4))
        X = (np.stack([d**0, d, d**2, k, k**2, d * k], 1) if shape == "quadratic_depth_peak" else np.stack([d**p for p in range(6)], 1))
        res = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
        assert r["n"] == len(y)
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean(res**2)), rel=1e-5, abs=1e-5)
        assert r["r2"] == pytest.approx(1 - np.sum(res**2) / np.sum((y - y.mean()) ** 2), abs=1e-6)


def test_scoring_end_to_end(spark, tmp_path):
    log = spark.createDataFrame(
        [(at(30 + i), "CSO", w, at(30 + i), float(i + 1)) for i in range(9) for w in ("w", "nogauge", "nocurve")],
        "poll_time_utc timestamp, advisory_type string, waterbody string, occurred_on timestamp, volume double")
    polls = spark.createDataFrame([(at(0), "w", "g"), (at(0), "nogauge", "x"), (at(0), "nocurve", "g")],
                                  "poll_time_utc timestamp, waterbody string, sensor_id string")
    rain = spark.createDataFrame([(str(h), "g", at(h), Decimal("0.1") * (h % 3)) for h in range(60)],
                                 "id string, sensor_id string, occurred_on timestamp, precip_in decimal(12,4)")
    config = spark.createDataFrame([("w", [("CSO", 0.1, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5])])],
                                   "name string, advisoryTypes array<struct<shortName:string,rainfallThreshold:double,coefficients:array<double>>>")
    predicted = workflows.score_overflows(log, polls, config, rain)
    fits = workflows.write_overflow_scores(predicted, str(tmp_path / "est"), str(tmp_path / "log"), "monday")
    assert spark.read.parquet(str(tmp_path / "est")).count() == 9
    for run in ("tuesday", "monday"):
        workflows.write_overflow_scores(predicted, str(tmp_path / "est"), str(tmp_path / "log"), run)
    scored = writers.read_scores(spark, str(tmp_path / "log"), cso.scores(predicted).schema).collect()
    assert sorted(r["run"] for r in scored) == ["monday", "tuesday"] and scored[0]["n_observations"] == 9 and scored[0]["n_waterbodies"] == 1
    assert fits.count() == 2

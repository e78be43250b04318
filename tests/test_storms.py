from __future__ import annotations

import random
from decimal import Decimal

import pytest

from stormline.functions.clock import HOUR
from stormline.operators import storms
from tests.conftest import at, hours
from tests.test_panel import make


def brute(cells, gap):
    out = []
    for s in sorted({s for s, _ in cells}):
        wet = sorted((h, Decimal(str(p))) for (g, h), p in cells.items() if g == s and p is not None and p > 0)
        for h, p in wet:
            if out and out[-1][0] == s and h - out[-1][2] <= gap:
                out[-1][2], out[-1][3], out[-1][4] = h, out[-1][3] + p, max(out[-1][4], p)
            else:
                out.append([s, h, h, p, p])
    return out


def random_rain(seed, length=800, wet=0.2):
    rng = random.Random(seed)
    return {(g, float(h)): rng.choice([0.01, 0.05, 0.3, 1.1, 0, -1, None]) for g in "aab" for h in range(length)
            if rng.random() < wet}


@pytest.mark.parametrize("gap", [4, 6])
@pytest.mark.parametrize("cell", [24, 17, 10_000])
def test_storms_equal_brute_force(spark, gap, cell):
    cells = random_rain(cell)
    got = storms.storms(make(spark, cells), gap, cell * HOUR).collect()
    want = brute(cells, gap)
    assert sorted((r[0], hours(r[1]), hours(r[2]), r[3], r[4]) for r in got) == sorted(map(tuple, want))
    assert sum(r["depth"] for r in got) == sum(Decimal(str(p)) for p in cells.values() if p and p > 0)


def test_only_positive_hours_are_wet(spark):
    cells = {("a", 0.0): 0, ("a", 1.0): None, ("a", 2.0): 0.01, ("a", 3.0): -5}
    got = storms.storms(make(spark, cells)).collect()
    assert [(hours(r["start"]), hours(r["end"]), r["depth"]) for r in got] == [(2.0, 2.0, Decimal("0.01"))]


@pytest.mark.parametrize("cell", [9, 24, 10_000])
def test_every_wet_hour_knows_its_storm(spark, cell):
    cells = random_rain(cell, wet=0.4)
    got = {(r["sensor_id"], hours(r["hour"])): hours(r["storm_start"])
           for r in storms.storm_ids(make(spark, cells), 6, cell * HOUR).collect()}
    spans = brute(cells, 6)
    want = {(s, h): next(b[1] for b in spans if b[0] == s and b[1] <= h <= b[2])
            for (s, h), p in cells.items() if p is not None and p > 0}
    assert got == want


@pytest.mark.parametrize("cell", [9, 24, 10_000])
@pytest.mark.parametrize("wet", [0.05, 0.4])
def test_storm_so_far_equals_brute_force(spark, cell, wet):
    cells = random_rain(cell, length=400, wet=wet)
    rng = random.Random(cell)
    asked = sorted({(g, float(rng.randrange(-10, 500)) + rng.choice([0, 0.5])) for g in "abz" for _ in range(60)})
    probes = spark.createDataFrame([(g, at(h)) for g, h in asked], "sensor_id string, hour timestamp")
    got = {(r["sensor_id"], hours(r["hour"])): (r["depth"], r["peak"])
           for r in storms.storm_state(make(spark, cells), probes, 4, cell * HOUR).collect()}
    assert set(got) == set(asked)
    for g, t in asked:
        past = {k: p for k, p in cells.items() if k[0] == g and k[1] <= t}
        spans = brute(past, 4)
        assert got[(g, t)] == ((spans[-1][3], spans[-1][4]) if spans else (0, 0)), (g, t)


def test_rain_at_the_observation_counts_and_old_storms_last(spark):
    cells = {("a", 10.0): 1, ("a", 12.0): 2, ("a", 13.0): 4}
    probes = spark.createDataFrame([("a", at(12)), ("a", at(9)), ("a", at(24 * 40))], "sensor_id string, hour timestamp")
    got = {hours(r["hour"]): (r["depth"], r["peak"], hours(r["storm_start"])) for r in storms.storm_state(make(spark, cells), probes, 4).collect()}
    assert got == {9.0: (0, 0, None), 12.0: (3, 2, 10.0), 960.0: (7, 4, 10.0)}

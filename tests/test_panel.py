from __future__ import annotations

import random
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from stormline.operators import panel, storms
from tests.conftest import at, hours

SCHEMA = "sensor_id string, hour timestamp, precip decimal(12,4)"


def make(spark, cells):
    return spark.createDataFrame(
        [(s, at(h), None if p is None else Decimal(str(p))) for (s, h), p in cells.items()], SCHEMA)


def read(df, *names):
    return {(r["sensor_id"], hours(r["hour"])): tuple(r[n] for n in names) for r in df.collect()}


def random_panel(seed, gauges=5, length=240, wet=0.5, null=0.1, absent=0.05):
    rng = random.Random(seed)
    cells = {}
    for h in range(length):
        if rng.random() < absent:
            continue
        for g in range(gauges):
            p = None if rng.random() < null else 0 if rng.random() > wet else rng.choice([0.01, 0.02, 0.5, 1.25, 4])
            cells[(f"g{g}", float(h))] = p
    return cells


def others_of(cells, s, h):
    values = [Decimal(str(p)) for (o, hh), p in cells.items() if hh == h and o != s and p is not None]
    return median(values) if values else None


def test_first_reading_of_an_hour_wins(spark):
    rows = [("b", "g", at(1), 5), ("a", "g", at(1), 3), ("c", "g", at(2), 1), ("d", "g", None, 9)]
    df = spark.createDataFrame([(i, s, t, Decimal(p)) for i, s, t, p in rows],
                               "id string, sensor_id string, occurred_on timestamp, precip_in decimal(12,4)")
    assert read(panel.dedup_hours(df), "precip") == {("g", 1.0): (3,), ("g", 2.0): (1,)}


def test_grid_has_every_reported_stamp_and_no_other(spark):
    cells = {("a", 0.0): 1, ("b", 30.0): 2, ("b", 30.25): 3}
    grid = read(panel.panel_grid(make(spark, cells)), "precip")
    assert set(grid) == {(s, h) for s in "ab" for h in (0.0, 30.0, 30.25)}
    assert {k: v[0] for k, v in grid.items() if v[0] is not None} == cells


@pytest.mark.parametrize("cells,expected", [
    ({("a", 0.0): 1}, {("a", 0.0): None}),
    ({("a", 0.0): 1, ("b", 0.0): 3}, {("a", 0.0): 3, ("b", 0.0): 1}),
    ({("a", 0.0): 1, ("b", 0.0): None}, {("a", 0.0): None, ("b", 0.0): 1}),
    ({("a", 0.0): 2, ("b", 0.0): 2, ("c", 0.0): 2}, {("a", 0.0): 2, ("b", 0.0): 2, ("c", 0.0): 2}),
])
def test_loo_median_small_groups(spark, cells, expected):
    got = {k: v[0] for k, v in read(panel.loo_median(make(spark, cells)), "others").items()}
    assert got == expected


@pytest.mark.parametrize("gauges", [2, 3, 4, 7, 8])
def test_loo_median_equals_brute_force(spark, gauges):
    cells = random_panel(gauges, gauges=gauges, length=60, null=0.2)
    got = read(panel.loo_median(make(spark, cells)), "others")
    for s, h in cells:
        assert got[(s, h)][0] == others_of(cells, s, h)


def test_spikes_are_zeroed_only_beside_dry_neighbours(spark):
    cells = {("a", 0.0): 3.3, ("b", 0.0): 0, ("c", 0.0): 0.01,
             ("a", 1.0): 3.2, ("b", 1.0): 0, ("c", 1.0): 0,
             ("a", 2.0): 3.3, ("b", 2.0): 0.02, ("c", 2.0): 0.02,
             ("a", 3.0): 5, ("b", 3.0): None, ("c", 3.0): None}
    got = read(panel.spike_repair(make(spark, cells)), "precip", "spike")
    assert [got[("a", float(h))] for h in range(4)] == [(0, True), (Decimal("3.2"), False), (Decimal("3.3"), False), (5, False)]


def test_neighbours_see_the_repaired_value(spark):
    cells = {("a", 0.0): 4, ("b", 0.0): 0, ("c", 0.0): 0.01, ("d", 0.0): 0}
    got = read(panel.spike_repair(make(spark, cells)), "others")
    assert got[("b", 0.0)][0] == 0 and got[("c", 0.0)][0] == 0


RULES = panel.QualityRules(window_hours=12, dead_own_under="0.5", dead_others_over="1.0", margin_hours=3)


class SmallCells(panel.QualityRules):
    """The same rules on cells shorter than the record, so that borders matter."""

    @property
    def cell_length(self):
        return 31 * panel.HOUR


SMALL = SmallCells(window_hours=12, dead_own_under="0.5", dead_others_over="1.0", margin_hours=3)


def brute_control(cells, rules):
    """Quality control cell by cell, straight from the rules."""
    first = {k: others_of(cells, *k) for k in cells}
    fixed = {k: (0 if p is not None and p > 3.2 and first[k] is not None and first[k] < Decimal("0.02") else p)
             for k, p in cells.items()}
    others = {k: others_of(fixed, *k) for k in fixed}

    def trailing(values, s, h):
        window = [values[(o, t)] for (o, t) in values if o == s and h - rules.window_hours < t <= h]
        present = [Decimal(str(v)) for v in window if v is not None]
        return sum(present) if present else None

    dead = set()
    for s, h in fixed:
        own, near = trailing(fixed, s, h), trailing(others, s, h)
        if own is not None and near is not None and own < Decimal(rules.dead_own_under) and near > Decimal(rules.dead_others_over):
            dead.add((s, h))
    masked = {(s, h) for s, h in fixed if any((s, t) in dead for (o, t) in fixed if o == s and h <= t < h + rules.window_hours)}
    final = {k: (None if k in masked else p) for k, p in fixed.items()}
    near_null = {(s, h) for s, h in final if any(
        o == s and p is None and abs(t - h) <= rules.margin_hours for (o, t), p in final.items())}
    return dead, masked, final, near_null


@pytest.mark.parametrize("rules", [RULES, SMALL])
@pytest.mark.parametrize("seed,null", [(1, 0.0), (2, 0.05)])
def test_quality_control_equals_brute_force(spark, rules, seed, null):
    cells = random_panel(seed, gauges=4, length=150, wet=0.35, null=null)
    dead, masked, final, near = brute_control(cells, rules)
    assert dead and len(masked) < len(cells)
    df = make(spark, cells)
    flags = read(panel.dead_flags(panel.spike_repair(df, rules), rules), "dead")
    assert {k for k, v in flags.items() if v[0]} == dead
    got = read(panel.quality_control(df, rules), "precip", "masked", "near_null")
    assert set(got) == set(cells)
    for k in cells:
        want = None if final[k] is None else Decimal(str(final[k]))
        assert got[k] == (want, k in masked, k in near), k


def test_all_null_window_is_not_dead(spark):
    cells = {("a", float(h)): None for h in range(48)} | {("b", float(h)): 1 for h in range(48)} | {
        ("c", float(h)): 1 for h in range(48)}
    flags = read(panel.dead_flags(panel.spike_repair(make(spark, cells), RULES), RULES), "own_sum", "dead")
    assert flags[("a", 40.0)] == (None, False)


def test_a_flag_masks_the_window_before_it(spark):
    df = spark.createDataFrame([("a", at(h), Decimal(0), Decimal(0)) for h in range(0, 24 * 60, 24)], SCHEMA + ", others decimal(18,5)")
    rules = panel.QualityRules()
    flagged = panel._with_halo(df, rules.window, rules.window, rules.cell_length).withColumn("dead", F.col("hour") == F.lit(at(24 * 50)))
    reach = panel._nearest(F.col("dead"), True) - F.col("_t")
    masked = panel._owned(flagged.withColumn("m", reach < rules.window), rules.cell_length).where("m")
    days = sorted(hours(r["hour"]) / 24 for r in masked.collect())
    assert days == list(range(21, 51))


def test_outages_and_reliable_hours(spark):
    cells = [("a", at(h), None if 10 <= h < 13 or h == 20 else Decimal(1), 10 <= h < 13 or h == 20) for h in range(30)]
    df = spark.createDataFrame(cells, SCHEMA + ", masked boolean")
    assert [tuple(r) for r in panel.outage_days(df).collect()] == [("a", 4, 2, 3, 4 / 24)]
    assert panel.outage_days(df, 0).count() == 0
    assert panel.reliable_hours(df).first()["reliable_hours"] == 26


def test_storms_beside_missing_hours_are_dropped(spark):
    """A null exactly six hours after the end drops a storm, seven hours after does not."""
    cells = {("a", float(h)): 0 for h in range(-20, 30)} | {("a", 0.0): 1, ("a", 2.0): 1, ("a", 8.0): None}
    cells |= {("b", float(h)): 0 for h in range(-20, 30)} | {("b", 0.0): 1, ("b", 2.0): 1, ("b", 9.0): None, ("b", -7.0): None}
    cells |= {("c", float(h)): 0 for h in range(-20, 30)} | {("c", 0.0): 1, ("c", -6.0): None}
    cells |= {("d", float(h)): 0 for h in range(-20, 30)} | {("d", 0.0): 1, ("d", 3.0): None, ("d", 6.0): 1}
    kept = storms.storms(panel.mark_near_null(make(spark, cells)))
    assert [r["sensor_id"] for r in kept.collect()] == ["b"]

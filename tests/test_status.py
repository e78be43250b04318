from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stormline.operators import nearest, status
from tests.conftest import at, hours


def test_newest_samples(spark):
    rows = [("a", at(2 * h), Decimal(h)) for h in range(120)] + [("b", at(0), None)]
    df = spark.createDataFrame(rows, "sensor_id string, hour timestamp, precip decimal(12,4)")
    last = status.last_samples(df)
    assert last.where("sensor_id = 'a'").count() == 96 and last.agg(F.min("precip")).first()[0] == 24
    got = {r["sensor_id"]: (r["rain_in"], r["samples"]) for r in status.accumulated_rain(df).collect()}
    assert got == {"a": (sum(range(96, 120)), 24), "b": (0, 1)}


@pytest.mark.parametrize("left,active,until", [(0.0, False, None), (2.5, True, 2.0), (0.5, True, 0.0), (None, False, None), (-1.0, False, None)])
def test_end_drops_the_fraction(spark, left, active, until):
    df = spark.createDataFrame([(at(0), left)], "occurred_on timestamp, duration_hr double")
    row = status.advisory_status(df).first()
    assert (row["has_advisory"], hours(row["until"])) == (active, until)


def test_list_filters_and_sorts(spark):
    df = spark.createDataFrame([("beta Creek", True), ("Alpha creek", False), ("alpha Bay", True)], "name string, has_advisory boolean")
    names = lambda **kw: [r["name"] for r in status.status_list(df, **kw).collect()]
    assert names() == ["alpha Bay", "Alpha creek", "beta Creek"]
    assert names(keyword=" CREEK ") == ["Alpha creek", "beta Creek"]
    assert names(keyword="creek", only_on_advisory=True) == ["beta Creek"]


def test_volume_classes(spark):
    cases = {0.0: "No discharge", 5.0: "≤5 MG", 5.01: "≤20 MG", 20.0: "≤20 MG", 50.0: "≤50 MG", 200.0: "≤200 MG",
             500.0: "≤500 MG", 1000.0: "≤1,000 MG", 1000.1: ">1,000 MG", None: "No discharge"}
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    assert [r[0] for r in df.select(status.volume_class(F.col("v"))).collect()] == list(cases.values())


def test_progress(spark):
    cases = {(3.0, "CSO"): 50, (9.0, "cso"): 100, (50.0, "WQ"): 25, (24.0, "other"): 50, (0.0, "WQ"): 0}
    df = spark.createDataFrame(list(cases), "h double, k string")
    assert [r[0] for r in df.select(status.progress_percent(F.col("h"), F.col("k"))).collect()] == list(cases.values())


def test_gauge_by_id_before_name(spark):
    gauges = spark.createDataFrame([("a", "b"), ("b", "Bay"), ("c", "Bay"), ("d", None)], "sensor_id string, sensor_name string")
    bodies = spark.createDataFrame([("w1", "b"), ("w2", "Bay"), ("w3", "none"), ("w4", ""), ("w5", None)], "waterbody string, gauge_ref string")
    got = {r["waterbody"]: r["sensor_id"] for r in status.resolve_gauges(bodies, gauges).collect()}
    assert got == {"w1": "b", "w2": "b", "w3": None, "w4": None, "w5": None}


def test_water_classes(spark):
    df = spark.createDataFrame([("SB(WW)",), ("I",), ("?",), (None,)], "c string")
    got = [r[0] for r in df.select(status.water_class(F.col("c"))["label"]).collect()]
    assert got == ["Class SB(WW)", "Class I", None, None]


def ground(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * nearest.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("levels", [1, 3, None])
@pytest.mark.parametrize("spread", ["city", "globe", "far cluster"])
def test_nearest_equals_brute_force(spark, levels, spread):
    rng = random.Random(7)

    def place(kind):
        if spread == "globe":
            return rng.uniform(-180, 180), rng.uniform(-89, 89)
        shift = 5 if spread == "far cluster" and kind == "w" else 0
        return -74 + shift + rng.uniform(0, 0.5), 40.5 + rng.uniform(0, 0.4)

    bodies = {i: place("w") for i in range(40)} | {50: (179.99, 0.0), 51: (-74.0, 40.6), 52: (-74.0, 40.6)}
    outs = {i: place("o") for i in range(120)} | {200: (-179.99, 0.1), 201: (-74.0, 40.6)}
    w = spark.createDataFrame([(i, *p, float(i)) for i, p in bodies.items()] + [(99, None, None, 1.0)], "waterbody_id long, lon double, lat double, volume double")
    o = spark.createDataFrame([(i, *p) for i, p in outs.items()] + [(300, None, 1.0)], "outfall_id long, lon double, lat double")
    got = {r["outfall_id"]: r for r in nearest.nearest_waterbody(o, w, levels).collect()}
    assert got[300]["waterbody_id"] is None and got[300]["volume"] == 0
    for i, p in outs.items():
        best = min((ground(p, q), k) for k, q in bodies.items())
        assert got[i]["waterbody_id"] == best[1] and got[i]["distance_m"] == pytest.approx(best[0], abs=1e-3)
        assert got[i]["volume"] == float(best[1])


def test_shapes_count_by_their_vertices(spark):
    shapes = spark.createDataFrame([(1, None, [(0.0, 0.0), (0.0, 2.0)]), (2, 7.0, [(0.0, 1.2)])],
                                   "waterbody_id long, volume double, vertices array<struct<lon:double,lat:double>>")
    o = spark.createDataFrame([(1, 0.0, 1.1), (2, 0.0, 1.9)], "outfall_id long, lon double, lat double")
    got = {r["outfall_id"]: (r["waterbody_id"], r["volume"]) for r in nearest.nearest_waterbody(o, nearest.vertices(shapes)).collect()}
    assert got == {1: (2, 7.0), 2: (1, 0.0)}


OUTLINE = "waterbody_id long, volume double, vertices array<struct<lon:double,lat:double>>"


def flat(p, a, b):
    """Distance in degrees of a plane, and where the foot lies."""
    d = (b[0] - a[0], b[1] - a[1])
    size = d[0] ** 2 + d[1] ** 2
    t = 0 if size == 0 else max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / size))
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def inside(p, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def test_outlines_count_by_their_edges_and_their_inside(spark):
    rng = random.Random(11)
    rings = {}
    for n in range(12):  # stars on a lattice near the equator, where a plane is exact enough
        x, y = 0.1 * (n % 4), 0.1 * (n // 4) - 0.1
        ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in (
            (2 * math.pi * i / 9, rng.choice((0.012, 0.04))) for i in range(9))]
        rings[n] = ring[::-1] if n % 2 else ring
    given = {n: [*ring, ring[0]] if n % 3 == 0 else [ring[0], *ring] for n, ring in rings.items()}
    shapes = spark.createDataFrame([(n, float(n), ring) for n, ring in given.items()] + [(90, 1.0, []), (91, 1.0, None), (92, 5.0, [(0.5, 0.5)])], OUTLINE)
    points = {i: (rng.uniform(-0.05, 0.35), rng.uniform(-0.15, 0.15)) for i in range(400)} | {900: (0.5, 0.501)}
    outs = spark.createDataFrame([(i, *p) for i, p in points.items()], "outfall_id long, lon double, lat double")
    got = {r["outfall_id"]: r for r in nearest.nearest_waterbody(outs, nearest.outline_segments(shapes)).collect()}
    within = 0
    for i, p in points.items():
        if i == 900:
            assert got[i]["waterbody_id"] == 92 and got[i]["distance_m"] == pytest.approx(111.2, abs=0.1)
            continue
        held = [n for n, ring in rings.items() if inside(p, ring)]
        near = {n: min(flat(p, a, b) for a, b in zip(ring, ring[1:] + ring[:1])) for n, ring in rings.items()}
        best = held[0] if held else min(near, key=near.get)
        within += bool(held)
        assert got[i]["waterbody_id"] == best
        assert got[i]["distance_m"] == pytest.approx(0 if held else near[best] * 111195, rel=2e-3, abs=0.5)
    assert 60 < within < 340
    lines = {r["outfall_id"]: r for r in nearest.nearest_waterbody(outs, nearest.outline_segments(shapes, closed=False)).collect()}
    assert all(r["distance_m"] > 0 for r in lines.values())


def test_one_far_place_leaves_the_search_local(spark):
    rng = random.Random(3)
    city = [(i, -74 + rng.uniform(0, 0.3), 40.5 + rng.uniform(0, 0.3), 1.0) for i in range(3000)]
    schema = "waterbody_id long, lon double, lat double, volume double"
    outs = spark.createDataFrame([(i, x + 0.001, y, ) for i, x, y, _ in city] + [(9999, 10.0, -50.0)], "outfall_id long, lon double, lat double")

    def pairs(bodies):
        found = nearest.nearest_waterbody(outs, spark.createDataFrame(bodies, schema))
        found.collect()
        seen = []
        walk = [found._jdf.queryExecution().executedPlan()]
        while walk:  # rows of the joins on cells
            node = walk.pop()
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                seen.append(node.metrics().apply("numOutputRows").value())
            inner = [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
            walk += inner + [node.children().apply(i) for i in range(node.children().size())]
        return max(seen)

    near, far = pairs(city), pairs([*city, (5000, 100.0, 70.0, 1.0), (5001, -160.0, -70.0, 1.0)])
    assert near < 150 * len(city) and far < 1.5 * near


def test_no_waterbodies(spark):
    w = spark.createDataFrame([], "waterbody_id long, lon double, lat double, volume double")
    o = spark.createDataFrame([(1, 0.0, 1.1)], "outfall_id long, lon double, lat double")
    assert nearest.nearest_waterbody(o, w).first()["volume"] == 0

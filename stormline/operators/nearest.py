"""Nearest waterbody of every outfall, exact and without comparing all pairs.

Waterbodies are segments of outlines (a point is a segment without length). They sit in
a tree whose cells are cut at quantiles of each axis, so one far place takes one cell and
not the whole extent. Outfalls are searched as cells of their own quantiles, not one by
one: a step keeps, per outfall cell, only those waterbody cells that may still hold the
nearest segment of some outfall in it, and the next step looks at their children alone.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

EARTH_RADIUS_M = 6371008.8
FAN = 4          # cells per axis and step
KNOTS = 1024     # quantiles an axis is cut at; cells between two of them are of equal width
AXES = ("x", "y", "z")
BOX = [f"w{a}{i}" for a in AXES for i in (0, 1)]


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def vertices(shapes: DataFrame, shape: str = "vertices") -> DataFrame:
    """One point per vertex of an array of ``struct<lon, lat>``."""
    rest = [c for c in shapes.columns if c != shape]
    return shapes.select(*rest, F.inline(shape))


def outline_segments(shapes: DataFrame, closed: bool = True, shape: str = "vertices") -> DataFrame:
    """The edges of outlines (``waterbody_id, volume`` and an array of ``struct<lon, lat>``).

    A closed outline also joins its last vertex to its first, knows its turning sense, and at
    which vertices it bends inwards; that is what tells an outfall inside from one outside. Repeated
    vertices count once. An outline of one vertex is a point.
    """
    clean = F.filter(shape, lambda v: v.isNotNull() & v["lon"].isNotNull() & v["lat"].isNotNull())
    rows = shapes.select("waterbody_id", "volume", clean.alias("_v"))
    # A vertex that repeats the one before it is no vertex; nor is a last one that repeats the first.
    rows = rows.withColumn("_v", F.filter("_v", lambda v, i: (i == 0) | ~v.eqNullSafe(F.get("_v", i - 1))))
    rows = rows.where(F.size("_v") > 0).withColumn("_n", F.size("_v"))
    if closed:
        again = (F.col("_n") > 1) & F.get("_v", F.lit(0)).eqNullSafe(F.element_at("_v", -1))
        rows = rows.withColumn("_v", F.when(again, F.slice("_v", 1, F.col("_n") - 1)).otherwise(F.col("_v")))
        rows = rows.withColumn("_n", F.size("_v"))

    def at(i: Column) -> Column:
        return F.get("_v", F.pmod(i, F.col("_n")))

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])

    edges = F.greatest(F.lit(1), F.col("_n") if closed else F.col("_n") - 1)
    area = F.aggregate(F.transform("_v", lambda v, i: turn(F.get("_v", F.lit(0)), v, at(i + 1))), F.lit(0.0), lambda x, y: x + y)
    ring = F.lit(closed) & (F.col("_n") > 2)
    rows = rows.withColumn("_sense", F.when(ring, F.signum(area)).otherwise(F.lit(0.0)))
    rows = rows.select("waterbody_id", "volume", "_v", "_n", "_sense", F.explode(F.sequence(F.lit(0), edges - 1)).alias("_i"))
    i = F.col("_i")

    def inwards(j: Column) -> Column:
        return F.col("_sense") * turn(at(j - 1), at(j), at(j + 1)) < 0

    return rows.select(
        "waterbody_id", "volume", at(i)["lon"].alias("lon"), at(i)["lat"].alias("lat"), at(i + 1)["lon"].alias("lon2"),
        at(i + 1)["lat"].alias("lat2"), F.col("_sense").alias("sense"), inwards(i).alias("bend"), inwards(i + 1).alias("bend2"))


def _on_sphere(df: DataFrame, end: str = "") -> DataFrame:
    """Unit-sphere coordinates: plain distances there order points as ground distance does."""
    lon, lat = F.radians(f"lon{end}"), F.radians(f"lat{end}")
    return df.select("*", (F.cos(lat) * F.cos(lon)).alias(f"x{end}"), (F.cos(lat) * F.sin(lon)).alias(f"y{end}"),
                     F.sin(lat).alias(f"z{end}"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def segment_distance(p: list[Column], lon: Column, lat: Column, seg: Column) -> Column:
    """struct(distance_m, inside) of a point to a segment of a great circle, and whether it lies inside its outline.

    Where the foot of the perpendicular lies between the ends, that is the cross-track
    distance and the side decides; elsewhere the nearer end counts, and the point is inside
    where the outline bends inwards.
    """
    a, b = [seg[x] for x in AXES], [seg[f"{x}2"] for x in AXES]
    n = _cross(a, b)
    length = F.sqrt(_dot(n, n))
    between = (length > 0) & (_dot(_cross(n, a), p) > 0) & (_dot(_cross(b, n), p) > 0)
    side = _dot(p, n) / F.when(length > 0, length)
    to_a, to_b = haversine_m(lon, lat, seg["lon"], seg["lat"]), haversine_m(lon, lat, seg["lon2"], seg["lat2"])
    across = EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.abs(side)))
    return F.when(between, F.struct(across.alias("distance_m"), (side * seg["sense"] > 0).alias("inside"))).when(
        to_a <= to_b, F.struct(to_a.alias("distance_m"), seg["bend"].alias("inside"))).otherwise(
        F.struct(to_b.alias("distance_m"), seg["bend2"].alias("inside")))


def _cell_of(edges: np.ndarray, shares: list[float], cells: int):
    @F.pandas_udf("long")
    def cell(values: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.floor(np.interp(values, edges, shares) * cells), cells - 1).astype("int64"))

    return cell


def _cells(points: DataFrame, cells: int, prefix: str) -> DataFrame:
    """Cell numbers on each axis, cut at quantiles of the points themselves: few numbers reach the driver."""
    shares = [i / KNOTS for i in range(KNOTS + 1)]
    knots = points.agg(*[F.percentile_approx(a, shares, 10 * KNOTS).alias(a) for a in AXES]).first()
    out = points
    for a in AXES:
        cell = _cell_of(np.array(knots[a] or [0.0] * (KNOTS + 1)), shares, cells)
        out = out.withColumn(f"{prefix}{a}", cell(F.col(a)))
    return out


def nearest_waterbody(outfalls: DataFrame, waterbodies: DataFrame, levels: int | None = None) -> DataFrame:
    """Each outfall with its nearest waterbody, the distance in metres and its volume.

    ``outfalls`` has ``outfall_id, lon, lat``; ``waterbodies`` is what ``outline_segments``
    gives, or has ``waterbody_id, lon, lat, volume``, one row per point. The distance goes to
    the outline, and is 0 inside a closed one (outlines that overlap: the one whose edge is
    nearest counts). Equal distances go to the smallest id. Rows without a position match
    nothing; a missing volume is 0.
    """
    if "lon2" not in waterbodies.columns:
        waterbodies = waterbodies.select(
            "waterbody_id", "volume", "lon", "lat", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"),
            F.lit(0.0).alias("sense"), F.lit(False).alias("bend"), F.lit(False).alias("bend2"))
    kind = {f.name: f.dataType for f in waterbodies.schema.fields}["waterbody_id"]
    ends = ["lon", "lat", "lon2", "lat2"]
    placed = waterbodies.dropna("any", subset=ends)
    # Segments at one place are one candidate; coordinates are taken on the sphere, so all of it compares by distance.
    flags = ["sense", "bend", "bend2"]
    segments = placed.groupBy(*ends).agg(F.min(F.struct("waterbody_id", "volume", *flags)).alias("_body"))
    segments = _on_sphere(_on_sphere(segments), "2")
    n = segments.count()
    if n == 0:
        return outfalls.select("*", F.lit(None).cast(kind).alias("waterbody_id"),
                               F.lit(None).cast("double").alias("distance_m"), F.lit(0.0).alias("volume"))
    if levels is None:
        levels = max(1, math.ceil(math.log(n, FAN * FAN)))
    # The box of a segment, with room for the bow of its arc.
    bow = reduce(Column.__add__, [(F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in AXES]) / 7
    boxed = segments.select(
        *[F.least(a, f"{a}2") - bow if i == 0 else F.greatest(a, f"{a}2") + bow for a in AXES for i in (0, 1)],
        F.struct(*ends, *AXES, *[f"{a}2" for a in AXES], "_body.sense", "_body.bend", "_body.bend2").alias("_seg"),
        "_body", *[((F.col(a) + F.col(f"{a}2")) / 2).alias(a) for a in AXES]).toDF(*BOX, "_seg", "_body", *AXES)
    indexed = _cells(boxed, FAN ** levels, "i")

    def key_at(level: int) -> Column:
        step = FAN ** (levels - level)
        return F.concat_ws(":", *[(F.col(f"i{a}") - F.pmod(f"i{a}", F.lit(step))) for a in AXES])

    leaves = indexed.withColumn("wcell", key_at(levels))
    bounds = [(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX]
    tree = [indexed.groupBy(key_at(level - 1).alias("parent"), key_at(level).alias("wcell")).agg(*bounds)
            for level in range(1, levels + 1)]

    asked = _on_sphere(outfalls.dropna("any", subset=["lon", "lat"]).select("outfall_id", "lon", "lat").distinct())
    asked = _cells(asked, FAN ** levels, "j").withColumn("qcell", F.concat_ws(":", *[f"j{a}" for a in AXES]))
    frontier = asked.groupBy("qcell").agg(
        *[F.min(a).alias(f"q{a}0") for a in AXES], *[F.max(a).alias(f"q{a}1") for a in AXES]
    )
    # The top level has at most FAN^3 cells, so it is one array and not a join.
    top = tree[0].agg(F.collect_list(F.struct("wcell", *BOX))).scalar()
    frontier = _prune(frontier.withColumn("_top", F.explode(top)).select(*frontier.columns, "_top.*"))
    for children in tree[1:]:
        opened = frontier.withColumnRenamed("wcell", "parent").join(children, "parent").drop("parent")
        frontier = _prune(opened)

    candidates = frontier.select("qcell", "wcell").join(leaves.select("wcell", "_seg", "_body"), "wcell").select(
        "qcell", "_seg", "_body")
    reach = segment_distance([F.col(a) for a in AXES], F.col("lon"), F.col("lat"), F.col("_seg"))
    met = asked.select("outfall_id", "lon", "lat", *AXES, "qcell").join(candidates, "qcell").select(
        "outfall_id", "lon", "lat", reach.alias("_r"), "_body")
    found = met.groupBy("outfall_id", "lon", "lat").agg(F.min(F.struct(
        F.col("_r.distance_m"), F.col("_body.waterbody_id"), F.col("_body.volume"), F.col("_r.inside"))).alias("_hit"))
    return outfalls.join(found, ["outfall_id", "lon", "lat"], "left").select(
        *outfalls.columns, F.col("_hit.waterbody_id").alias("waterbody_id"),
        F.when(F.col("_hit.inside"), F.lit(0.0)).otherwise(F.col("_hit.distance_m")).alias("distance_m"),
        F.coalesce("_hit.volume", F.lit(0.0)).alias("volume"))


def _prune(opened: DataFrame) -> DataFrame:
    """Drop the waterbody cells that cannot hold the nearest point of any outfall in the cell."""
    def low(a: str) -> Column:
        gap = F.greatest(F.lit(0.0), F.col(f"w{a}0") - F.col(f"q{a}1"), F.col(f"q{a}0") - F.col(f"w{a}1"))
        return gap * gap

    def high(a: str) -> Column:
        reach = F.greatest(F.abs(F.col(f"w{a}1") - F.col(f"q{a}0")), F.abs(F.col(f"q{a}1") - F.col(f"w{a}0")))
        return reach * reach

    nearest = reduce(Column.__add__, [low(a) for a in AXES])
    farthest = reduce(Column.__add__, [high(a) for a in AXES])
    best = F.min("_high").over(Window.partitionBy("qcell"))
    bounded = opened.select(
        "qcell", *[f"q{a}{i}" for a in AXES for i in (0, 1)], "wcell",
        nearest.alias("_low"), farthest.alias("_high"))
    # The slack covers rounding in the coordinates.
    return bounded.withColumn("_best", best).where(
        F.col("_low") <= F.col("_best") * F.lit(1 + 1e-9) + F.lit(1e-18)).drop("_low", "_high", "_best")

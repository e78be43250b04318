from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stormline.functions.clock import HOUR
from stormline.operators.spans import fold_spans, match_spans, with_previous


def fold(spark, rows, gap=0, cell=7, points=False, **kw):
    df = spark.createDataFrame(rows, "k string, s long, e long").select(
        "k", (F.col("s") * HOUR).alias("s"), (F.col("e") * HOUR).alias("e"))
    out = fold_spans(df, ["k"], "s", "s" if points else "e", gap=gap * HOUR, cell_length=cell * HOUR, **kw)
    return sorted((r["k"], r["start_us"] // HOUR, r["end_us"] // HOUR) for r in out.collect())


def brute(rows, gap=0):
    out = []
    for k, s, e in sorted(rows):
        if out and out[-1][0] == k and s - out[-1][2] <= gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([k, s, e])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("name,rows,expected", [
    ("touching", [("a", 0, 5), ("a", 5, 9)], [("a", 0, 9)]),
    ("apart", [("a", 0, 5), ("a", 6, 9)], [("a", 0, 5), ("a", 6, 9)]),
    ("nested", [("a", 0, 9), ("a", 2, 3)], [("a", 0, 9)]),
    ("long, short, then over the long", [("a", 0, 50), ("a", 1, 2), ("a", 40, 60)], [("a", 0, 60)]),
    ("starts on a cell border", [("a", 0, 7), ("a", 7, 8)], [("a", 0, 8)]),
    ("before the epoch", [("a", -20, -3), ("a", -3, 4)], [("a", -20, 4)]),
    ("one instant", [("a", 7, 7)], [("a", 7, 7)]),
])
def test_merge_boundaries(spark, name, rows, expected):
    assert fold(spark, rows) == expected


@pytest.mark.parametrize("gap", [4, 6])
def test_gap_is_strict(spark, gap):
    rows = [("a", 0, 0), ("a", gap, gap), ("b", 0, 0), ("b", gap + 1, gap + 1)]
    assert fold(spark, rows, gap=gap, points=True) == [("a", 0, gap), ("b", 0, 0), ("b", gap + 1, gap + 1)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("combine", [False, True])
def test_random_spans_equal_brute_force(spark, seed, combine):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randrange(-100, 900)
        rows.append((rng.choice("aaaab"), s, s + rng.choice([0, 1, 2, 3, 40])))
    rows = rng.sample(rows, 60 + 80 * seed)
    assert fold(spark, rows, combine=combine) == brute(rows)


@pytest.mark.parametrize("cell", [1, 5, 24, 10_000])
def test_cell_length_does_not_matter(spark, cell):
    rng = random.Random(cell)
    stamps = {("a" if rng.random() < 0.8 else "b", rng.randrange(2000)) for _ in range(500)}
    rows = [(k, s, s) for k, s in stamps]
    assert fold(spark, rows, gap=6, cell=cell, points=True) == brute(rows, 6)


def test_sums_follow_the_sessions(spark):
    rows = [("a", h, h) for h in (0, 1, 6, 8, 20, 26, 33)]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("v", F.lit(1).cast("decimal(12,4)"))
    out = fold_spans(df, ["k"], "s", "s", gap=6, cell_length=7, measures={"v": "sum"})
    assert sorted((r["start_us"], r["end_us"], int(r["v"])) for r in out.collect()) == [(0, 8, 4), (20, 26, 2), (33, 33, 1)]
    with pytest.raises(ValueError):
        fold_spans(df, ["k"], "s", "e", measures={"v": "sum"})


def test_merging_twice_changes_nothing(spark):
    rows = [("a", 0, 5), ("a", 3, 9), ("a", 30, 31)]
    once = fold(spark, rows)
    assert fold(spark, once) == once


def test_no_keys_folds_everything(spark):
    df = spark.createDataFrame([(0, 5), (4, 20), (30, 31)], "s long, e long")
    out = fold_spans(df, [], "s", "e", cell_length=7, combine=True)
    assert sorted((r[0], r[1]) for r in out.collect()) == [(0, 20), (30, 31)]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_partition_count_does_not_matter(spark, partitions):
    rows = [("a", s, s + 3) for s in range(0, 400, 5)] + [("a", 100, 290)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert fold(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_previous_row_crosses_cells(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice("aab"), rng.randrange(300)) for _ in range(80)})
    df = spark.createDataFrame([(k, t, t * 10) for k, t in rows], "k string, t long, v long")
    got = {(r["k"], r["t"]): r["prev_v"] for r in with_previous(df, ["k"], ["t"], "t", ["v"], cell_length=13).collect()}
    last: dict[str, int] = {}
    for k, t in rows:
        assert got[(k, t)] == last.get(k)
        last[k] = t * 10


def test_previous_row_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 50, "y")], "k string, t long, v string")
    got = {r["t"]: r["prev_v"] for r in with_previous(df, ["k"], ["t"], "t", ["v"], cell_length=10).collect()}
    assert got == {1: None, 50: "x"}


def test_match_is_inclusive_at_both_ends(spark):
    spans = spark.createDataFrame([(10, 20), (100, 300)], "start_us long, end_us long")
    points = spark.createDataFrame([(t,) for t in (9, 10, 20, 21, 150, 300, 301)], "t long")
    inside = sorted(r[0] for r in match_spans(points, "t", spans, length=50).collect())
    outside = sorted(r[0] for r in match_spans(points, "t", spans, how="left_anti", length=50).collect())
    assert inside == [10, 20, 150, 300]
    assert outside == [9, 21, 301]

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stormline.functions.numbers import round_half_even


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_rounding_follows_the_exact_value(spark, digits):
    rng = random.Random(digits)
    values = [2.5, 3.5, 0.25, 0.35, 39.55, 39.65, 39.75, 0.76155, 0.75765, -2.5, -0.25, 0.0, 1e15 + 0.5, 1e300, 5e-324]
    values += [rng.randrange(10**6) / 10 ** rng.choice([1, 2, 3, 5]) for _ in range(3000)]
    values += [rng.uniform(-500, 500) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_half_even(F.col("v"), digits).alias("r")).collect()
    wrong = [(r["v"], r["r"], round(r["v"], digits)) for r in got if r["r"] != round(r["v"], digits)]
    assert not wrong


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(round_half_even(F.col("v"), 1)).first()[0] is None

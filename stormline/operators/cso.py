"""Overflow volumes: observations, storm state, candidate formulas, scores and refits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stormline.functions.numbers import round_half_even
from stormline.operators.params import COEFFICIENTS
from stormline.operators.storms import CSO_GAP_HOURS, storm_state
from stormline.session import pinned

MIN_REFIT_POINTS = 7


def cso_observations(advisory_log: DataFrame, order: tuple[str, ...] = ("poll_time_utc",)) -> DataFrame:
    """Positive logged overflow volumes, the earliest poll per waterbody and onset."""
    return (
        advisory_log.where((F.col("advisory_type") == "CSO") & (F.col("volume") > 0))
        .groupBy("waterbody", "occurred_on")
        .agg(F.min_by("volume", F.struct(*order)).alias("volume"))
    )


def attach_storm_state(
    observations: DataFrame, gauges: DataFrame, panel: DataFrame, gap_hours: int = CSO_GAP_HOURS,
) -> DataFrame:
    """Depth and peak of the storm so far at each observation.

    Observations without a gauge, or on a gauge the panel lacks, are skipped. Many
    waterbodies share a gauge and a time, so each such pair is probed once.
    """
    known = panel.select("sensor_id").distinct()
    placed = observations.join(gauges, "waterbody").join(known, "sensor_id", "left_semi")
    probes = placed.select("sensor_id", F.col("occurred_on").alias("hour"))
    state = storm_state(panel, probes, gap_hours).select(
        "sensor_id", F.col("hour").alias("occurred_on"), "depth", "peak")
    return placed.join(state, ["sensor_id", "occurred_on"]).select(
        "waterbody", "occurred_on", F.col("depth").cast("double").alias("depth"),
        F.col("peak").cast("double").alias("peak"), "volume")


def quadratic_depth_peak(d: Column, k: Column) -> Column:
    a, b, c, e1, e2, e3 = (F.col(x) for x in COEFFICIENTS)
    return a + b * d + c * d * d + e1 * k + e2 * k * k + e3 * d * k


def poly5_depth(d: Column) -> Column:
    a, b, c, c3, c4, c5 = (F.col(x) for x in COEFFICIENTS)
    return a + d * (b + d * (c + d * (c3 + d * (c4 + d * c5))))


def predictions(states: DataFrame, params: DataFrame) -> DataFrame:
    """Both candidate formulas with the published coefficients, no free parameter."""
    d, k = F.col("depth"), F.col("peak")
    return states.join(params, "waterbody").withColumn(
        "pred_quadratic_depth_peak", quadratic_depth_peak(d, k)).withColumn("pred_poly5_depth", poly5_depth(d))


def r2_and_rmse(pred: Column, actual: Column) -> tuple[Column, Column]:
    """Aggregates: 1 - SSres/SStot (null for a constant target) and the root mean square.

    SStot comes from the merged central moment, which needs neither a second pass nor
    a difference of large squares.
    """
    residual = actual - pred
    ss_res = F.sum(residual * residual)
    ss_tot = F.var_pop(actual) * F.count(actual)
    return F.when(ss_tot > 0, 1 - ss_res / ss_tot), F.sqrt(F.avg(residual * residual))


def scores(predicted: DataFrame) -> DataFrame:
    """One row: observations, waterbodies, and both candidates' scores to 4 digits."""
    columns = [F.count(F.lit(1)).alias("n_observations"), F.countDistinct("waterbody").alias("n_waterbodies")]
    for name in ("quadratic_depth_peak", "poly5_depth"):
        r2, rmse = r2_and_rmse(F.col(f"pred_{name}"), F.col("volume"))
        columns += [r2.alias(f"{name}_r2"), rmse.alias(f"{name}_rmse")]
    scored = predicted.agg(*columns)
    counts = ("n_observations", "n_waterbodies")
    return scored.select(*counts, *[round_half_even(F.col(c), 4).alias(c) for c in scored.columns if c not in counts])


# Both shapes are linear in their six coefficients. Depth and peak are mapped to [-1, 1]
# and the degree-5 shape is written in Legendre polynomials, so the normal equations
# stay well conditioned.
def _quadratic_basis(d: Column, k: Column) -> list[Column]:
    return [F.lit(1.0), d, d * d, k, k * k, d * k]


def _legendre_basis(d: Column, k: Column) -> list[Column]:
    basis = [F.lit(1.0), d]
    for n in range(1, 5):
        basis.append(((2 * n + 1) * d * basis[n] - n * basis[n - 1]) / (n + 1))
    return basis


SHAPES = {"quadratic_depth_peak": _quadratic_basis, "poly5_depth": _legendre_basis}


def refit(states: DataFrame, min_points: int = MIN_REFIT_POINTS) -> DataFrame:
    """Best least-squares score per waterbody and shape, for groups of ``min_points`` or more.

    The normal equations are plain sums, combined before the shuffle, so a waterbody of
    any size costs one small row. Only the 6 x 6 solve runs in Python. Residuals are
    taken in a second pass and not from the sums, which would cancel; the states are
    written once for all passes.
    """
    states = pinned(states)
    spread = states.groupBy("waterbody").agg(
        F.count(F.lit(1)).alias("_n"), F.min("depth").alias("_d0"), F.max("depth").alias("_d1"),
        F.min("peak").alias("_k0"), F.max("peak").alias("_k1"))

    def scaled(x: str, low: str, high: str) -> Column:
        width = F.col(high) - F.col(low)
        return F.when(width > 0, 2 * (F.col(x) - F.col(low)) / width - 1).otherwise(F.lit(0.0))

    points = (
        states.join(spread.where(F.col("_n") >= min_points), "waterbody")
        .select("waterbody", "volume", scaled("depth", "_d0", "_d1").alias("_d"),
                scaled("peak", "_k0", "_k1").alias("_k"))
    )
    rows = [F.struct(F.lit(shape).alias("shape"), F.array(*basis(F.col("_d"), F.col("_k"))).alias("_x"))
            for shape, basis in SHAPES.items()]
    design = points.select("waterbody", "volume", F.inline(F.array(*rows)))
    x = [F.col("_x")[i] for i in range(6)]
    sums = design.groupBy("waterbody", "shape").agg(
        F.array(*[F.sum(x[i] * x[j]) for i in range(6) for j in range(6)]).alias("gram"),
        F.array(*[F.sum(x[i] * F.col("volume")) for i in range(6)]).alias("moment"))
    solved = sums.mapInPandas(_solve, "waterbody string, shape string, weights array<double>")
    fitted = F.aggregate(
        F.zip_with("_x", "weights", lambda a, b: a * b), F.lit(0.0), lambda total, term: total + term)
    r2, rmse = r2_and_rmse(F.col("_fit"), F.col("volume"))
    return (
        design.join(solved, ["waterbody", "shape"]).withColumn("_fit", fitted)
        .groupBy("waterbody", "shape").agg(F.count(F.lit(1)).alias("n"), r2.alias("r2"), rmse.alias("rmse"))
    )


def _solve(batches):
    for batch in batches:
        weights = [
            np.linalg.lstsq(np.array(gram, dtype=float).reshape(6, 6), np.array(moment, dtype=float), rcond=1e-12)[0]
            for gram, moment in zip(batch["gram"], batch["moment"])
        ]
        yield pd.DataFrame({"waterbody": batch["waterbody"], "shape": batch["shape"],
                            "weights": [w.tolist() for w in weights]})


def estimates(predicted: DataFrame) -> DataFrame:
    """The export of every observation; coefficient ``d`` keeps its name apart from depth."""
    return predicted.select(
        "waterbody", "occurred_on", "depth", "peak", "volume", *COEFFICIENTS,
        F.col("peak").alias("k"), "pred_quadratic_depth_peak", "pred_poly5_depth")

"""Waterbody parameters: latest rows, nested model configuration, changes and drift."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stormline.functions.clock import DAY, micros
from stormline.operators.spans import with_previous

WQ_PARAMS = ["waterbody", "sensor_id", "wq_threshold_in", "wq_coeff_a", "wq_coeff_b"]

# Keys that change between polls without a change of the model.
VOLATILE_KEYS = ["createdOn", "$type", "activeSensor"]

# The six coefficients of an overflow curve.
COEFFICIENTS = ["a", "b", "c", "d", "e", "f"]


def latest_per_waterbody(waterbody_log: DataFrame, order: Sequence[str] = ("poll_time_utc",)) -> DataFrame:
    """The newest poll row of each waterbody, as an aggregate so that old rows never travel.

    Rows alike in ``order`` are told apart by their content, so the choice is stable.
    """
    rest = [c for c in waterbody_log.columns if c not in ("waterbody", *order)]
    newest = waterbody_log.groupBy("waterbody").agg(
        F.max(F.struct(*order, *rest)).alias("_row"))
    return newest.select("waterbody", "_row.*")


def latest_params(waterbody_log: DataFrame, order: Sequence[str] = ("poll_time_utc",)) -> DataFrame:
    """Newest advisory parameters; a null in the newest row drops the waterbody."""
    slim = waterbody_log.select(*dict.fromkeys([*WQ_PARAMS, *order]))
    return latest_per_waterbody(slim, order).select(*WQ_PARAMS).dropna("any")


def gauge_map(waterbody_log: DataFrame, order: Sequence[str] = ("poll_time_utc",)) -> DataFrame:
    slim = waterbody_log.select(*dict.fromkeys(["waterbody", "sensor_id", *order]))
    return latest_per_waterbody(slim, order).select("waterbody", "sensor_id")


def advisory_type(types: Column, short_name: str) -> Column:
    """The first advisory type of that short name, or null."""
    return F.try_element_at(F.filter(types, lambda t: t["shortName"] == short_name), F.lit(1))


def coefficient(coefficients: Column, position: int) -> Column:
    """The 1-based coefficient, null when the list is short or missing."""
    return F.try_element_at(coefficients, F.lit(position))


def cso_params(config: DataFrame) -> DataFrame:
    """Overflow coefficients of the waterbodies that have any non-zero one."""
    coefs = advisory_type(F.col("advisoryTypes"), "CSO")["coefficients"]
    return (
        config.withColumn("_coefs", coefs)
        .where(F.coalesce(F.exists("_coefs", lambda x: x != 0), F.lit(False)))
        .select(F.col("name").alias("waterbody"),
                *[coefficient(F.col("_coefs"), i + 1).alias(c) for i, c in enumerate(COEFFICIENTS)])
    )


def _drop_volatile(found: dict) -> dict:
    for key in VOLATILE_KEYS:
        found.pop(key, None)
    return found


# Volatile keys go as each object is read, so no document is walked a second time.
_READER, _WRITER = json.JSONDecoder(object_hook=_drop_volatile), json.JSONEncoder(sort_keys=True)


def _digest(text: str | None) -> str | None:
    try:
        parsed = _READER.decode(text)
    except (TypeError, ValueError, RecursionError):
        return None
    return hashlib.sha256(_WRITER.encode(parsed).encode("utf-8", "replace")).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_hash(payloads: pd.Series) -> pd.Series:
    """Hash of a whole configuration text, whatever keys it has, less the volatile keys at every depth.

    Key order and layout don't count; list order and the kind of a number (1 or 1.0) do. Null
    for a text that isn't JSON. Documents nest to any depth, which no column expression
    walks, so each text is parsed by itself, in Arrow batches.
    """
    return payloads.map(_digest)


# Else a filter on the hash is moved below whatever made the text, where every text is parsed once more.
canonical_hash = canonical_hash.asNondeterministic()


def config_changes(snapshots: DataFrame, keys: Sequence[str] = ("config_key",), order: Sequence[str] = ()) -> DataFrame:
    """Snapshots whose canonical content differs from the one before it.

    Expects ``poll_time_utc`` and ``payload``. A payload that doesn't parse carries no
    configuration and is passed over.
    """
    hashed = snapshots.withColumn("config_hash", canonical_hash(F.col("payload"))).where("config_hash is not null")
    return hash_changes(hashed, keys, order)


def hash_changes(hashed: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``config_hash`` differs from the row before, per key and by poll time."""
    rows = hashed.withColumn("_t", micros("poll_time_utc"))
    compared = with_previous(rows, keys, ["_t", *order], "_t", ["config_hash"], cell_length=90 * DAY)
    return compared.where(~F.col("config_hash").eqNullSafe(F.col("prev_config_hash"))).drop("_t", "prev_config_hash")


def param_drift(old: DataFrame, new: DataFrame, key: str = "wbid", labels: tuple[str, str] = ("old", "new")) -> DataFrame:
    """Two vintages of the six coefficients side by side; ``changed`` if any pair differs."""
    before, after = labels
    left = old.select(key, *[F.col(c).alias(f"{c}_{before}") for c in COEFFICIENTS])
    right = new.select(key, *[F.col(c).alias(f"{c}_{after}") for c in COEFFICIENTS])
    differs = F.lit(False)
    for c in COEFFICIENTS:
        differs = differs | ~F.col(f"{c}_{before}").eqNullSafe(F.col(f"{c}_{after}"))
    pairs = [f"{c}_{label}" for c in COEFFICIENTS for label in labels]
    return left.join(right, key).select(key, differs.alias("changed"), *pairs)


def drift_counts(drift: DataFrame, labels: tuple[str, str] = ("old", "new")) -> DataFrame:
    """How many curves changed and how many are all zero in each vintage."""
    def all_zero(label: str) -> Column:
        zero = F.lit(True)
        for c in COEFFICIENTS:
            zero = zero & (F.coalesce(F.col(f"{c}_{label}"), F.lit(0.0)) == 0)
        return zero

    return drift.agg(
        F.count(F.lit(1)).alias("waterbodies"), F.count_if("changed").alias("changed"),
        *[F.count_if(all_zero(label)).alias(f"all_zero_{label}") for label in labels])

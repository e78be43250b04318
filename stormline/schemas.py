"""Explicit schemas of every source; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PRECIP = T.DecimalType(12, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _D, _TS, _B = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType()

READINGS = _struct(("id", _S), ("sensor_id", _S), ("occurred_on", _TS), ("precip_in", PRECIP))

WATERBODY_LOG = _struct(
    ("poll_time_utc", _TS), ("waterbody", _S), ("wbid", T.IntegerType()), ("sensor_id", _S),
    ("rain_24h_in", _D), ("wq_threshold_in", _D), ("wq_coeff_a", _D), ("wq_coeff_b", _D),
    ("cso_threshold_in", _D), ("provisional_on_advisory", _B),
)
SENSOR_LOG = _struct(
    ("poll_time_utc", _TS), ("sensor_id", _S), ("sensor_name", _S), ("rain_24h_in", _D), ("active", _B),
)
ADVISORY_LOG = _struct(
    ("poll_time_utc", _TS), ("advisory_type", _S), ("waterbody", _S), ("wb_api_id", _S),
    ("wb_class", _S), ("rain_gauge", _S), ("occurred_on", _TS), ("duration_hr", _D), ("volume", _D),
)

# Live payloads.
WATERBODY_OBJECT = _struct(
    ("name", _S), ("wbid", T.IntegerType()),
    ("activeSensor", _struct(("id", _S), ("accumulatedLast24Hours", _D))),
    ("advisoryTypes", T.ArrayType(_struct(
        ("shortName", _S), ("rainfallThreshold", _D), ("coefficients", T.ArrayType(_D))))),
)
SENSOR_OBJECT = _struct(("id", _S), ("name", _S), ("accumulatedLast24Hours", _D), ("active", _B))
ADVISORY_OBJECT = _struct(
    ("waterbody", _struct(("id", _S), ("name", _S), ("class", _S), ("rainGauge", _S))),
    ("occurredOn", _S), ("duration", _D), ("volume", _D),
)
POLLS = _struct(("poll_time_utc", _TS), ("payload", _S))

COMPLETENESS = _struct(("sensor_id", _S), ("complete", _B), ("records", T.LongType()), ("updated", _TS))

# Legacy parameter layer. Person names in the source are not carried.
LEGACY_LAYER = _struct(("features", T.ArrayType(_struct(("attributes", _struct(
    ("Waterbod_1", _S), ("Prim_RainG", _S),
    ("A_Curve", _D), ("B_Curve", _D), ("C_Curve", _D),
    ("D_Curve", _D), ("E_Curve", _D), ("F_Curve", _D),
    ("Rainfall_T", _D), ("peak_inten", _D),
    ("manual_ove", T.IntegerType()), ("WBID", T.IntegerType()), ("Advisory", T.IntegerType()),
    ("Expires", T.LongType()), ("Hours", _D),
    ("Creation_1", T.LongType()), ("EditDate_1", T.LongType()),
))))))

"""Live JSON payloads flattened to log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from stormline.functions.clock import tolerant_timestamp
from stormline.functions.numbers import round_half_even
from stormline.operators.ingest import record_key
from stormline.operators.params import advisory_type, coefficient
from stormline.schemas import ADVISORY_OBJECT, SENSOR_OBJECT, WATERBODY_OBJECT

# The keys under which a wrapped record list may stand, in order.
LIST_KEYS = ["items", "results", "data", "records", "values"]


def rain_or_zero(rows: DataFrame, column: str = "rain_24h_in") -> DataFrame:
    """A missing day's rain reads 0; kept to 4 digits."""
    return rows.withColumn(column, F.coalesce(column, F.lit(0.0))).withColumn(
        column, round_half_even(F.col(column), 4))


def provisional(rain: Column, threshold: Column) -> Column:
    """Rain of the last day meets the trigger; without a threshold it never does."""
    return F.coalesce(rain >= threshold, F.lit(False))


def _objects(polls: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per object of a payload's list. A list with entries that aren't objects loses those alone."""
    whole = F.from_json("payload", T.ArrayType(schema))
    entries = F.filter(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>"),
                       lambda entry: F.schema_of_variant(entry).startswith("OBJECT"))
    one_by_one = F.transform(entries, lambda entry: F.from_json(F.to_json(entry), schema))
    # The parser takes a bare object for a list of one, which would make a row of an error message.
    listed = F.when(F.col("payload").rlike(r"^\s*\["), F.coalesce(whole, one_by_one))
    return polls.select("poll_time_utc", F.explode(listed).alias("o")).where("o is not null")


def poll_state(polls: DataFrame, schema: T.StructType, name: str = "state") -> DataFrame:
    """Adds what became of a poll: ``missing``, ``unparsed``, ``not a list``, ``empty``, ``partly read`` or ``read``.

    Partly read: some entries of the list aren't objects, or have a field of another type than
    the schema's, so a row or a field of it is lost. The parsed page is a column that all
    tests read, so a payload is parsed once.
    """
    def lost(entry: Column) -> Column:
        wrong = ~F.schema_of_variant(entry).startswith("OBJECT")
        for field in schema.fields:
            held = F.try_variant_get(entry, f"$.{field.name}", "variant")
            there = F.coalesce(F.schema_of_variant(held) != "VOID", F.lit(False))
            wrong = wrong | (there & F.try_variant_get(entry, f"$.{field.name}", field.dataType.simpleString()).isNull())
        return wrong

    entries = F.col("_entries")
    state = (F.when(F.col("payload").isNull(), "missing").when(F.col("_page").isNull(), "unparsed")
             .when(entries.isNull(), "not a list").when(F.size(entries) == 0, "empty")
             .when(F.exists(entries, lost), "partly read").otherwise("read"))
    return (polls.withColumn("_page", F.try_parse_json("payload"))
            .withColumn("_entries", F.try_variant_get("_page", "$", "array<variant>"))
            .withColumn(name, state).drop("_page", "_entries"))


def poll_quality(polls: DataFrame, schema: T.StructType, by: Sequence[str] = ()) -> DataFrame:
    """How many polls of each state came in, and when the first and the last.

    The flattening operators pass over what they can't read; this is where it is counted.
    """
    state = poll_state(polls, schema).select(*by, "poll_time_utc", "state")
    return state.groupBy(*by, "state").agg(
        F.count(F.lit(1)).alias("polls"), F.min("poll_time_utc").alias("first_poll"), F.max("poll_time_utc").alias("last_poll"))


def watched(polls: DataFrame, schema: T.StructType, name: str | Observation) -> DataFrame:
    """The same polls; whatever job or micro-batch reads them also reports ``polls`` and those not fully read.

    With a name, a stream reports the counters as observed metrics of each micro-batch.
    """
    lost = [F.count_if(F.col("_state") == s).alias(s.replace(" ", "_")) for s in ("missing", "unparsed", "not a list", "partly read")]
    return poll_state(polls, schema, "_state").observe(name, F.count(F.lit(1)).alias("polls"), *lost).drop("_state")


def waterbody_rows(polls: DataFrame) -> DataFrame:
    """Waterbody polls (``poll_time_utc, payload``) to rows of the waterbody log."""
    rows = _objects(polls, WATERBODY_OBJECT).select(
        "poll_time_utc", F.col("o.name").alias("waterbody"), F.col("o.wbid").alias("wbid"),
        F.col("o.activeSensor.id").alias("sensor_id"),
        F.col("o.activeSensor.accumulatedLast24Hours").alias("rain_24h_in"),
        advisory_type(F.col("o.advisoryTypes"), "WQ").alias("_wq"),
        advisory_type(F.col("o.advisoryTypes"), "CSO").alias("_cso"))
    return rain_or_zero(rows).select(
        "poll_time_utc", "waterbody", "wbid", "sensor_id", "rain_24h_in",
        F.col("_wq.rainfallThreshold").alias("wq_threshold_in"),
        coefficient(F.col("_wq.coefficients"), 1).alias("wq_coeff_a"),
        coefficient(F.col("_wq.coefficients"), 2).alias("wq_coeff_b"),
        F.col("_cso.rainfallThreshold").alias("cso_threshold_in"),
        provisional(F.col("rain_24h_in"), F.col("_wq.rainfallThreshold")).alias("provisional_on_advisory"))


def sensor_rows(polls: DataFrame) -> DataFrame:
    return rain_or_zero(_objects(polls, SENSOR_OBJECT).select(
        "poll_time_utc", F.col("o.id").alias("sensor_id"), F.col("o.name").alias("sensor_name"),
        F.col("o.accumulatedLast24Hours").alias("rain_24h_in"), F.col("o.active").alias("active")))


def advisory_rows(polls: DataFrame, kind: str) -> DataFrame:
    """Advisory polls of one type to rows of the advisory log."""
    return _objects(polls, ADVISORY_OBJECT).select(
        "poll_time_utc", F.lit(kind).alias("advisory_type"), F.col("o.waterbody.name").alias("waterbody"),
        F.col("o.waterbody.id").alias("wb_api_id"), F.col("o.waterbody.class").alias("wb_class"),
        F.col("o.waterbody.rainGauge").alias("rain_gauge"),
        tolerant_timestamp(F.col("o.occurredOn")).alias("occurred_on"),
        F.col("o.duration").alias("duration_hr"), F.col("o.volume").alias("volume"))


def all_advisory_rows(wq_polls: DataFrame, cso_polls: DataFrame) -> DataFrame:
    return advisory_rows(wq_polls, "WQ").unionByName(advisory_rows(cso_polls, "CSO"))


def unwrap_records(pages: DataFrame, column: str = "payload") -> DataFrame:
    """One variant per record, from a bare list or a list under a known key; others yield none."""
    page = F.try_parse_json(column)
    lists = [F.try_variant_get(page, "$", "array<variant>")] + [
        F.try_variant_get(page, f"$.{key}", "array<variant>") for key in LIST_KEYS]
    rest = [c for c in pages.columns if c != column]
    records = pages.select(*rest, F.explode(F.coalesce(*lists)).alias("record"))
    return records.where(F.schema_of_variant("record").startswith("OBJECT"))


def sample_rows(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Pages of rainfall samples to keyed readings.

    Only text, whole-number and true/false ids count as a record's own id.
    """
    def text(path: str) -> Column:
        return F.try_variant_get("record", path, "string")

    kind = F.schema_of_variant(F.try_variant_get("record", "$.id", "variant"))
    own = F.when(kind.isin("STRING", "BIGINT"), text("$.id")).when(kind == "BOOLEAN", F.initcap(text("$.id")))
    sensor, occurred = text("$.sensorId"), text("$.occurredOn")
    rest = [c for c in pages.columns if c != column]
    return unwrap_records(pages, column).select(
        *rest, record_key(own, sensor, occurred).alias("id"), sensor.alias("sensor_id"),
        tolerant_timestamp(occurred).alias("occurred_on"),
        F.try_variant_get("record", "$.precipitation", "decimal(12,4)").alias("precip_in"))

"""The data model derived from the given tables, whole tables throughout.

``events`` play the gauges (a user is a gauge, an event a reading), ``lineitem`` the
polls (a supplier is a waterbody, a line a poll row), ``orders`` the filings, and
``supplier`` and ``customer`` the places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stormline.operators import filings as filing_ops
from stormline.operators.panel import QualityRules, dedup_hours, panel_grid
from stormline.schemas import PRECIP
from stormline.session import shared_dir
from stormline.sources.readers import NO_DATE_MS

POLL_ORDER = ("poll_time_utc", "poll_id")

# The given tables span 30 days, so quality windows are days and not weeks.
RULES = QualityRules(window_hours=72)
# One gauge of the dense panel falls silent for a week.
SILENT, SILENT_FROM, SILENT_TO = "Q1", "2024-01-09", "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of one small file over all cores; a table with enough splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _named(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def _inches(value: str) -> Column:
    return (F.col(value).cast("decimal(12,2)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRECIP)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def as_readings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("id"), _named("G", "user_id").alias("sensor_id"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("occurred_on"), _inches("value").alias("precip_in"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_hours(readings(spark, sf_dir))


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten users to a gauge, summed per hour, dry hours filled with zero; one gauge reads zero for a week."""
    gauge, ts = _named("Q", F.floor(F.col("user_id") / 10)), F.col("ts").cast("timestamp")
    silent = (gauge == SILENT) & (ts >= F.lit(SILENT_FROM).cast("timestamp")) & (ts < F.lit(SILENT_TO).cast("timestamp"))
    read = F.when(silent, F.lit(0).cast(PRECIP)).otherwise(_inches("value"))
    sums = (
        table(spark, sf_dir, "events")
        .groupBy(gauge.alias("sensor_id"),
                 F.date_trunc("hour", "ts").cast("timestamp").alias("hour"))
        .agg(F.sum(read).cast(PRECIP).alias("precip"))
    )
    return panel_grid(sums).select("sensor_id", "hour", F.coalesce("precip", F.lit(0).cast(PRECIP)).alias("precip"))


def waterbody_log(spark: SparkSession, sf_dir: str, gauge: str = "G", low: bool = False) -> DataFrame:
    """Polls of the waterbodies; ``low`` thresholds and whole coefficients make far more storms trigger, for longer."""
    key = F.col("l_suppkey") if gauge == "G" else F.floor(F.col("l_suppkey") / 10)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).cast("timestamp").alias("poll_time_utc"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("poll_id"),
        _named("WB", "l_suppkey").alias("waterbody"), F.col("l_suppkey").cast("int").alias("wbid"),
        _named(gauge, key).alias("sensor_id"),
        F.round(F.col("l_extendedprice") / 100000, 4).alias("rain_24h_in"),
        F.when(F.col("l_tax") > 0, F.col("l_linenumber") / (10.0 if low else 2.0)).alias("wq_threshold_in"),
        (F.col("l_quantity") if low else F.col("l_quantity") / 20).alias("wq_coeff_a"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") + 0.5).alias("wq_coeff_b"),
        F.lit(0.1).alias("cso_threshold_in"))


def advisory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_advisories(table(spark, sf_dir, "events"))


def as_advisories(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "CSO").otherwise("WQ")
    # The codes to hand out, one of them unknown.
    codes = F.array(*[F.lit(c) for c in ("SA", "SB", "SB(WW)", "SC", "I", "SD", "XX")])
    return events.select(
        F.col("ts").cast("timestamp").alias("poll_time_utc"), F.col("event_id").alias("poll_id"),
        kind.alias("advisory_type"), _named("WB", "user_id").alias("waterbody"),
        F.col("user_id").cast("string").alias("wb_api_id"),
        F.element_at(codes, (F.col("user_id") % 7 + 1).cast("int")).alias("wb_class"),
        _named("G", "user_id").alias("rain_gauge"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("occurred_on"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") / 4).alias("duration_hr"),
        F.when(F.col("event_type") == "purchase", 0.0).otherwise(F.col("value")).alias("volume"))


def _advisory_types(wq_threshold: Column, wq: list[Column], cso: list[Column]) -> Column:
    def entry(name: str, threshold: Column, coefs: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("shortName"), threshold.cast("double").alias("rainfallThreshold"),
                        F.array(*[c.cast("double") for c in coefs]).alias("coefficients"))

    return F.array(entry("WQ", wq_threshold, wq), entry("CSO", F.lit(0.1), cso))


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``as_config_polls`` makes texts of, with ``poll_time_utc``: few bytes a poll, to be moved in its place."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice",
        "l_quantity")
    return lines.withColumn(
        "poll_time_utc", (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).cast("timestamp"))


def config_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_config_polls(spread(config_lines(spark, sf_dir)))


def as_config_polls(lines: DataFrame) -> DataFrame:
    """One configuration text per poll; key order and volatile keys vary without meaning, at every depth.

    Half of what changes stands in a nested object that no model of the document knows.
    """
    step = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    types = _advisory_types(step * 0.25, [step * 10, F.lit(0.5)], [step, F.lit(2), F.lit(0), F.lit(0.5), F.lit(0), F.lit(1)])
    samples = F.array(F.struct(F.col("l_extendedprice").alias("v"), F.array(F.col("l_linenumber")).alias("at")))
    sensor = F.struct(_named("G", "l_suppkey").alias("id"), samples.alias("samples"),
                      (F.col("l_extendedprice") / 100000).alias("accumulatedLast24Hours"))
    name, wbid = _named("WB", "l_suppkey").alias("name"), F.col("l_suppkey").cast("int").alias("wbid")
    created = F.date_format("l_shipdate", "yyyy-MM-dd").alias("createdOn")
    grade = (F.col("l_quantity") > 25).cast("int")
    review = F.array(F.struct(sensor.alias("activeSensor"), grade.alias("grade"), created)).alias("review")
    again = F.array(F.struct(created, grade.alias("grade"), sensor.alias("activeSensor"))).alias("review")
    one = F.struct(name, wbid, created, sensor.alias("activeSensor"), F.struct(review).alias("notes"), types.alias("advisoryTypes"))
    other = F.struct(types.alias("advisoryTypes"), F.struct(again).alias("notes"), sensor.alias("activeSensor"), wbid, created, name)
    return lines.select(
        "poll_time_utc",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("poll_id"),
        (step * 2 + grade).alias("revision"), _named("WB", "l_suppkey").alias("config_key"),
        F.when(F.col("l_linestatus") == "O", F.to_json(one)).otherwise(F.to_json(other)).alias("payload"))


def damaged_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waterbody polls of which some never arrived, broke off, or hold something else than a list of waterbodies."""
    n, text = F.col("poll_id") % 10, F.concat(F.lit("["), "payload", F.lit("]"))
    return config_polls(spark, sf_dir).select(
        "poll_time_utc", "config_key",
        F.when(n == 1, F.lit(None)).when(n == 2, F.substring(text, 1, 60)).when(n == 3, F.col("payload")).when(n == 4, "[]")
        .when(n == 5, F.concat(F.lit("[7,"), "payload", F.lit("]")))
        .when(n == 6, F.replace(text, F.lit('"wbid":'), F.lit('"wbid":"no ","was":'))).otherwise(text).alias("payload"))


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested configuration of every supplier; some overflow curves are all zero."""
    live = F.when(F.col("s_nationkey") % 6 == 0, 0.0).otherwise(1.0)
    curve = [F.col("s_nationkey") * 0.5, F.col("s_acctbal") / 1000, F.col("s_acctbal") / -5000, F.lit(1.5),
             (F.col("s_nationkey") % 4) * 0.25, F.lit(-0.125)]
    return table(spark, sf_dir, "supplier").select(
        _named("WB", "s_suppkey").alias("name"), F.col("s_suppkey").cast("int").alias("wbid"),
        _advisory_types(F.lit(0.5), [F.lit(10), F.lit(0.5)], [live * c for c in curve]).alias("advisoryTypes"))


def legacy_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the legacy layer: dates in epoch milliseconds, the mark for none among them."""
    day = F.col("s_suppkey") % 500
    curves = [(F.col("s_nationkey") * 0.5 + i).alias(f"{c}_Curve") for i, c in enumerate("ABCDEF")]
    stamp = F.when(F.col("s_nationkey") % 3 == 0, NO_DATE_MS).otherwise((day * 86400 + 1546300800) * 1000)
    attributes = F.struct(
        F.concat(_named("WB", "s_suppkey"), F.lit(" ")).alias("Waterbod_1"), _named("G", "s_suppkey").alias("Prim_RainG"), *curves,
        (F.col("s_acctbal") / 1000).alias("Rainfall_T"), (F.col("s_nationkey") % 2).alias("manual_ove"),
        F.col("s_suppkey").alias("WBID"), F.lit(0).alias("Advisory"), stamp.alias("Expires"),
        ((day * 86400 + 1546300800) * 1000).alias("Creation_1"))
    return table(spark, sf_dir, "supplier").select(attributes.alias("attributes"))


def vintages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sets of six coefficients per waterbody, from its first and its last poll."""
    flags = {"a": "l_returnflag = 'A'", "b": "l_linestatus = 'O'", "c": "l_discount > 0.05", "d": "l_tax > 0.04"}
    polls = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("wbid"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("_at"),
        F.struct(*[F.when(F.expr(test), 1.0).otherwise(0.0).alias(c) for c, test in flags.items()],
                 F.when(F.col("l_quantity") > 25, F.lit(None)).otherwise(0.0).alias("e"), F.lit(0.0).alias("f")).alias("_c"))
    ends = polls.groupBy("wbid").agg(F.min_by("_c", "_at").alias("old"), F.max_by("_c", "_at").alias("new"))
    return ends.select("wbid", "old.*"), ends.select("wbid", "new.*")


def _filing_fields() -> dict[str, Column]:
    """Filing fields of an order, by canonical name; the start is a stamp."""
    day = F.pmod(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")), F.lit(400))
    start = F.timestamp_seconds(F.lit(1704067200) + day * 86400 + (F.col("o_orderkey") % 24) * 3600
                                + (F.col("o_orderkey") % 60) * 60)
    n = (F.col("o_orderkey") % 40 + 1).cast("string")
    kind = F.floor("o_totalprice") % 7
    duration = (
        F.when(kind == 0, F.concat(n, F.lit(" Hours"))).when(kind == 1, F.concat(n, F.lit(" Minutes")))
        .when(kind == 2, F.concat(n, F.lit(" Days"))).when(kind == 3, n).when(kind == 4, F.lit("unknown"))
        .when(kind == 5, F.lit("2.5 hrs")).otherwise(F.concat(n, F.lit(" Weeks"))))
    plant = F.when(F.col("o_custkey") % 10 == 0, _named("NYCdep Plant ", "o_custkey")).otherwise(_named("Plant ", "o_custkey"))
    counties = F.array(*[F.lit(c) for c in ("Kings ", "QUEENS", "Erie", "Albany", "Monroe")])
    reasons = F.array(F.lit("Rain Event"), F.lit("CSO overflow"), F.lit("Pipe Break,Pipe Break"), F.lit(None).cast("string"))
    return {
        "facility": plant, "facility_id": F.col("o_custkey").cast("string"), "start": start,
        "end": F.lit(None).cast("string"), "duration": duration,
        "waterbody": _named("Creek ", F.col("o_custkey") % 100), "quantity": F.floor("o_totalprice").cast("string"),
        "treated": F.col("o_orderstatus"), "reason": F.element_at(reasons, (F.col("o_orderkey") % 4 + 1).cast("int")),
        "county": F.element_at(counties, (F.col("o_custkey") % 5 + 1).cast("int")), "city": F.lit("City"),
        "status": F.col("o_orderstatus"), "incident_id": F.col("o_orderkey").cast("string"),
        "notif_id": F.col("o_orderkey").cast("string"), "lat": F.lit("40.7"), "lon": F.lit("-74.0"),
    }


def filing_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All orders as sheets of four header eras, one cumulative sheet of repeats, and repeats inside a sheet.

    A row's place in its sheet doesn't follow its incident id, and the texts of one sheet are padded with tabs.
    """
    orders = table(spark, sf_dir, "orders")
    fields = _filing_fields()
    start = fields["start"]

    def sheet(rows: DataFrame, era: int, text: Column, skip: tuple[str, ...] = (), **changed: Column) -> DataFrame:
        cells = {**fields, "start": text, **changed}
        headers = {c: filing_ops.ALIASES[c] for c in cells if c not in skip}
        place = (F.col("o_orderkey") * 7919 % 100003).alias(filing_ops.ROW_NO)
        return rows.select(*[cells[c].alias(names[min(era, len(names) - 1)]) for c, names in headers.items()], place)

    priority = F.col("o_orderpriority")
    urgent = orders.where(priority == "1-URGENT")
    slash = F.date_format(start, "MM/dd/yyyy HH:mm:ss")
    mixed = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(start, "yyyyMMdd"))
        .when(F.col("o_orderstatus") == "O", F.date_format(start, "M/d/yyyy")).otherwise(F.lit(" ")))
    loud = F.concat(F.lit(" "), F.upper(fields["facility"]), F.lit(" "))
    high = orders.where(priority == "2-HIGH")
    tabbed = F.concat(F.lit("\t"), F.date_format(start, "M/d/yyyy H:mm"), F.lit("\t\n"))
    padded = {"duration": F.concat(fields["duration"], F.lit("\u00a0")), "county": F.concat(fields["county"], F.lit("\t"))}
    # Entered again further down, under an incident id that sorts before the first one.
    again = sheet(high.where("o_custkey % 3 = 0"), 1, tabbed, incident_id=F.concat(F.lit("0"), fields["incident_id"]), **padded)
    again = again.withColumn(filing_ops.ROW_NO, F.col(filing_ops.ROW_NO) + 200000)
    return {
        "2021-01": sheet(urgent, 0, slash),
        "2021-12 cumulative": sheet(urgent, 0, slash, facility=loud),
        "2022-01": sheet(high, 1, tabbed, **padded).unionByName(again),
        "2023-01": sheet(orders.where(priority == "3-MEDIUM"), 2, F.date_format(start, "yyyy-MM-dd HH:mm:ss")),
        "2024-01": sheet(orders.where(priority == "4-NOT SPECIFIED"), 2, F.date_format(start, "MMMM d, yyyy"),
                         skip=("city",)),
        "2025-01": sheet(orders.where(priority == "5-LOW"), 3, mixed, skip=("end", "city")),
    }


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_ops.union_sheets(filing_sheets(spark, sf_dir))


def _place(key: str, lon_step: int, lat_step: int) -> list[Column]:
    """Scattered but reproducible positions."""
    return [(F.lit(-74.3) + (F.col(key) * lon_step % 100003) / 100003.0 * 0.6).alias("lon"),
            (F.lit(40.5) + (F.col(key) * lat_step % 100019) / 100019.0 * 0.4).alias("lat")]


def outfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("outfall_id"), *_place("c_custkey", 7919, 104729))


def waterbody_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("waterbody_id"), *_place("s_suppkey", 3571, 15485863),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("volume"))


# The corners of the outline that every waterbody has, one of them bending inwards.
CORNERS = ((0, 0), (4, 0), (4, 3), (2, 1), (0, 3))


def waterbody_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines on a lattice, so that none overlap."""
    lon = F.lit(-74.3) + (F.col("s_suppkey") % 40) * 0.015
    lat = F.lit(40.5) + F.floor(F.col("s_suppkey") / 40) * 0.012
    shape = F.array(*[F.struct((lon + x * 0.003).alias("lon"), (lat + y * 0.003).alias("lat")) for x, y in CORNERS])
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("waterbody_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("volume"),
        shape.alias("vertices"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        _named("G", "user_id").alias("sensor_id"), _named("Gauge ", "user_id").alias("sensor_name"))


def gauge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waterbodies that name their gauge by id, by name, or not at all."""
    way = F.col("s_nationkey") % 3
    return table(spark, sf_dir, "supplier").select(
        _named("WB", "s_suppkey").alias("waterbody"),
        F.when(way == 0, _named("G", "s_suppkey")).when(way == 1, _named("Gauge ", "s_suppkey"))
        .otherwise(F.lit("")).alias("gauge_ref"))


# Landed files hold about this many rows each, so that no task writes or reads a fixed share of all rows.
ROWS_A_FILE = 250_000


def landed(rows: DataFrame, newest: str, batches: int = 4, build: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """A stream of ``rows`` in several micro-batches that don't follow time, and a folder for its results.

    The number of files grows with the rows; a micro-batch takes its share of the files. What
    ``build`` makes of the rows, row by row, is made once they lie in their place, and lands.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = max(1, -(-rows.count() // (batches * ROWS_A_FILE)))
    placed = rows.repartitionByRange(batches * files, F.desc(newest))
    whole = build(placed) if build else placed
    whole.write.parquet(f"{folder}/in")
    return stream_of(spark, whole.schema, f"{folder}/in", files), folder


def stream_of(spark: SparkSession, schema, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def history_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Saved readings up to mid-January, and a batch that overlaps them with other values.

    Readings of type 'error' have no id of their own; every batch row arrives twice.
    """
    from stormline.operators.ingest import record_key

    own = F.when(F.col("event_type") != "error", F.col("event_id"))
    keyed = table(spark, sf_dir, "events").select(
        record_key(own, _named("G", "user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("id"),
        _named("G", "user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("occurred_on"),
        _inches("value").alias("precip_in"))
    history = keyed.where(F.col("occurred_on") < F.lit("2024-01-16").cast("timestamp"))
    batch = keyed.where(F.col("occurred_on") >= F.lit("2024-01-10").cast("timestamp")).withColumn(
        "precip_in", (F.col("precip_in") + F.lit(1)).cast(PRECIP))
    again = batch.withColumn("precip_in", (F.col("precip_in") + F.lit(1)).cast(PRECIP))
    return history, batch.unionByName(again)

"""Registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stormline.functions.clock import tolerant_timestamp
from stormline.operators import (
    advisories, crosscheck, cso, filings, ingest, nearest, panel, params, status, storms,
)
from stormline.plans import adapters as A, workflows
from stormline.session import pin_time_zone, pinned, shared_dir
from stormline.schemas import ADVISORY_LOG, READINGS, WATERBODY_LOG, WATERBODY_OBJECT
from stormline.sources import payloads, readers, writers
from stormline.streaming import polls
from stormline.streaming.config import current_changes, keep_config_changes
from stormline.streaming.history import keep_history, read_history
from stormline.streaming.storms import current_storms, keep_storms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_time_zone(spark)
        return _plain(build(spark, sf_dir))

    # A trailing underscore keeps a function apart from the module of the same name.
    QUERIES[build.__name__.rstrip("_")] = run
    return build


def _plain(df: DataFrame) -> DataFrame:
    """Stamps as text and decimals as doubles, so results compare across engines."""
    def cell(field: T.StructField):
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


# Sources and payloads

@query
def flatten_payload(spark, d):
    asked = A.config_polls(spark, d).withColumn("payload", F.concat(F.lit("["), "payload", F.lit("]")))
    return payloads.waterbody_rows(asked)


@query
def flatten_sensors(spark, d):
    one = F.struct(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("id"),
                   F.concat(F.lit("Gauge "), F.col("user_id").cast("string")).alias("name"),
                   F.when(F.col("event_type") != "error", F.col("value") / 7).alias("accumulatedLast24Hours"),
                   (F.col("event_type") == "click").alias("active"))
    return payloads.sensor_rows(A.table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("poll_time_utc"), F.to_json(F.array(one)).alias("payload")))


@query
def flatten_advisories(spark, d):
    log = A.advisory_log(spark, d)
    body = F.struct(F.col("wb_api_id").alias("id"), F.col("waterbody").alias("name"), F.col("wb_class").alias("class"),
                    F.col("rain_gauge").alias("rainGauge"))
    occurred = F.date_format("occurred_on", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct(body.alias("waterbody"), occurred.alias("occurredOn"), F.col("duration_hr").alias("duration"), "volume")
    asked = log.select("advisory_type", "poll_time_utc", F.to_json(F.array(one)).alias("payload"))
    return payloads.all_advisory_rows(
        asked.where("advisory_type = 'WQ'").drop("advisory_type"), asked.where("advisory_type = 'CSO'").drop("advisory_type"))


@query
def poll_quality(spark, d):
    return payloads.poll_quality(A.damaged_polls(spark, d), WATERBODY_OBJECT)


@query
def unwrap_records(spark, d):
    sample = F.to_json(F.struct(
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("id"),
        F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("sensorId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurredOn"), F.col("value").alias("precipitation")))
    wrapped = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"items":['), sample, F.lit("]}")))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"total":1,"values":['), sample, F.lit(",3]}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"other":['), sample, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), sample, F.lit("]"))))
    return payloads.sample_rows(A.table(spark, d, "events").select(wrapped.alias("payload")))


@query
def filings_union(spark, d):
    return A.filings(spark, d).select("facility", "start", "duration", "waterbody", "reason", "county", "city", "incident_id", "sheet")


@query
def config_changes(spark, d):
    changed = params.config_changes(A.config_polls(spark, d), ["config_key"], ["poll_id", "revision"])
    return changed.select("config_key", "poll_time_utc", "poll_id")


# Ingest

@query
def record_key(spark, d):
    history, batch = A.history_and_batch(spark, d)
    return history.unionByName(batch).select("id", "sensor_id").distinct()


@query
def history_merge(spark, d):
    history, batch = A.history_and_batch(spark, d)
    return ingest.history_merge(history, batch, "id", ["occurred_on", "precip_in"])


@query
def fresh_counts(spark, d):
    history, batch = A.history_and_batch(spark, d)
    return ingest.fresh_counts(history, batch, "id", ["occurred_on", "precip_in"])


@query
def completeness(spark, d):
    history, batch = A.history_and_batch(spark, d)
    merged = ingest.history_merge(history, batch, "id", ["occurred_on", "precip_in"])
    users = A.table(spark, d, "events").select(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("sensor_id"), "event_type", "value")
    prior = users.groupBy("sensor_id").agg((F.max("value") > 250).alias("complete"))
    ended = users.groupBy("sensor_id").agg(F.count_if(F.col("event_type") == "signup").alias("n")).where("n >= 14")
    return ingest.completeness(merged, prior, ended, F.lit("2024-01-31").cast("timestamp"))


@query
def backfill_order(spark, d):
    return ingest.backfill_order(A.gauges(spark, d), completeness(spark, d))


@query
def harvest_progress(spark, d):
    return ingest.progress(completeness(spark, d))


@query
def continuity_gaps(spark, d):
    return ingest.continuity_gaps(A.hourly(spark, d))


@query
def dedup_hours(spark, d):
    return A.hourly(spark, d)


@query
def parse_timestamps(spark, d):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), F.date_format("ts", "yyyy-MM-dd"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return A.table(spark, d, "events").select("event_id", text.alias("raw")).select(
        "event_id", tolerant_timestamp(F.col("raw")).alias("parsed"))


# Files in their landed form, read by the readers

def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(rows, layout):
    """A few JSON documents, each with an array of the rows' objects as ``layout`` has it."""
    objects = rows.select(F.pmod(F.hash(*rows.columns), F.lit(4)).alias("part"), F.struct(*rows.columns).alias("o"))
    return objects.groupBy("part").agg(F.to_json(layout(F.collect_list("o"))).alias("value")).select("value")


@query
def gauge_files(spark, d):
    history, batch = A.history_and_batch(spark, d)
    path = _folder(spark, "gauges")
    merged = ingest.history_merge(history, batch, "id", ["occurred_on", "precip_in"])
    writers.write_gauge_files(merged.select(*READINGS.fieldNames()), path)
    return readers.gauge_history(spark, path)


@query
def waterbody_files(spark, d):
    path = _folder(spark, "log")
    log = A.waterbody_log(spark, d).withColumn("provisional_on_advisory", payloads.provisional(F.col("rain_24h_in"), F.col("wq_threshold_in")))
    log.select(*WATERBODY_LOG.fieldNames()).write.option("header", True).csv(path)
    return readers.waterbody_log(spark, path).drop("rain_24h_in")


@query
def advisory_files(spark, d):
    path = _folder(spark, "log")
    A.advisory_log(spark, d).select(*ADVISORY_LOG.fieldNames()).write.option("header", True).csv(path)
    return readers.advisory_log(spark, path)


@query
def config_files(spark, d):
    path = _folder(spark, "config")
    _documents(A.config(spark, d), lambda objects: objects).write.option("maxRecordsPerFile", 1).text(path)
    return params.cso_params(readers.model_config(spark, path))


@query
def legacy_files(spark, d):
    path = _folder(spark, "layer")
    _documents(A.legacy_attributes(spark, d), lambda objects: F.struct(objects.alias("features"))).write.option("maxRecordsPerFile", 1).text(path)
    return readers.legacy_layer(spark, path).select(
        "wbid", "waterbody", "a", "f", "threshold_in", "manual_override", "expires", "created")


@query
def stream_log(spark, d):
    polls_in = A.damaged_polls(spark, d).select("poll_time_utc", "payload")
    folder = _folder(spark, "stream")
    polls.land_polls(polls_in, f"{folder}/in")
    polls.append_log(polls.landed_polls(spark, f"{folder}/in"), "waterbodies", f"{folder}/log", f"{folder}/state").awaitTermination()
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy(F.col("poll_month").cast("string").alias("poll_month"), "waterbody").agg(
        F.count(F.lit(1)).alias("polls"), F.max("poll_time_utc").alias("last_poll"))


# Sinks, read back

@query
def log_replay(spark, d):
    # Three batches of a monthly log: one is written twice, and one more breaks off before its mark.
    rows = A.waterbody_log(spark, d).select("poll_time_utc", "poll_id", "waterbody", "wq_coeff_a")
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for batch in (0, 1, 1, 2):
        writers.append_monthly(rows.where(F.col("poll_id") % 3 == batch), path, batch)
    rows.withColumns({"poll_month": F.lit("2099-01"), "run": F.lit("0"), "batch": F.lit(3)}).write.mode("append").partitionBy(
        "poll_month", "run", "batch").parquet(path)
    return writers.read_monthly(spark, path, rows.schema)


@query
def history_rewrite(spark, d):
    history, batch = A.history_and_batch(spark, d)
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    writers.write_history(ingest.history_merge(history, batch, "id", ["occurred_on", "precip_in"]), path)
    return spark.read.schema(history.schema).parquet(path)


@query
def score_log(spark, d):
    scores = cso.scores(_predictions(spark, d))
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    for run in ("monday", "tuesday", "monday"):
        writers.append_scores(scores, path, run)
    return writers.read_scores(spark, path, scores.schema).drop(writers.SCORE_TIME)


# Parameters

@query
def latest_params(spark, d):
    return params.latest_params(A.waterbody_log(spark, d), A.POLL_ORDER)


@query
def cso_params(spark, d):
    return params.cso_params(A.config(spark, d))


@query
def provisional_flag(spark, d):
    return A.waterbody_log(spark, d).select(
        "poll_id", payloads.provisional(F.col("rain_24h_in"), F.col("wq_threshold_in")).alias("provisional_on_advisory"))


@query
def param_drift(spark, d):
    return params.param_drift(*A.vintages(spark, d))


@query
def drift_counts(spark, d):
    return params.drift_counts(params.param_drift(*A.vintages(spark, d)))


# Gauge quality

@query
def panel_grid(spark, d):
    return panel.panel_grid(A.hourly(spark, d))


@query
def loo_median(spark, d):
    return panel.loo_median(A.dense_panel(spark, d))


@query
def loo_median_sparse(spark, d):
    return panel.loo_median(A.hourly(spark, d))


@query
def spike_repair(spark, d):
    return panel.spike_repair(A.dense_panel(spark, d), A.RULES)


@query
def rolling_sums(spark, d):
    return panel.rolling_sums(panel.spike_repair(A.dense_panel(spark, d), A.RULES), A.RULES)


@query
def dead_flags(spark, d):
    return panel.dead_flags(panel.spike_repair(A.dense_panel(spark, d), A.RULES), A.RULES).select("sensor_id", "hour", "dead")


def _controlled(spark, d):
    return panel.quality_control(A.dense_panel(spark, d), A.RULES)


@query
def dead_mask(spark, d):
    return _controlled(spark, d).select("sensor_id", "hour", "precip", "masked", "near_null")


@query
def reliable_hours(spark, d):
    return panel.reliable_hours(_controlled(spark, d))


@query
def outage_days(spark, d):
    return panel.outage_days(_controlled(spark, d))


# Storms and advisories

@query
def storm_ids(spark, d):
    return storms.storm_ids(A.hourly(spark, d))


@query
def storms_(spark, d):
    return storms.storms(A.hourly(spark, d))


@query
def storms_reliable(spark, d):
    return storms.storms(_controlled(spark, d))


def _params(spark, d):
    return params.latest_params(A.waterbody_log(spark, d), A.POLL_ORDER)


def _storms(spark, d):
    return storms.storms(A.hourly(spark, d))


def _low_params(spark, d):
    return params.latest_params(A.waterbody_log(spark, d, low=True), A.POLL_ORDER)


@query
def triggered(spark, d):
    return advisories.triggered(_storms(spark, d), _low_params(spark, d)).select("waterbody", "start", "end", "depth", "peak")


@query
def advisory_until(spark, d):
    return advisories.advisory_until(_storms(spark, d), _low_params(spark, d)).select("waterbody", "start", "hours", "until")


def _episodes(spark, d):
    return advisories.episodes(_storms(spark, d), _params(spark, d))


@query
def episodes(spark, d):
    return _episodes(spark, d)


@query
def waterbody_summary(spark, d):
    return advisories.waterbody_summary(_params(spark, d), _episodes(spark, d), panel.reliable_hours(A.hourly(spark, d)))


@query
def waterbody_summary_qc(spark, d):
    log = A.waterbody_log(spark, d, "Q")
    return workflows.summarise(_controlled(spark, d), params.latest_params(log, A.POLL_ORDER))[0]


@query
def burden_topk(spark, d):
    return advisories.burden_topk(waterbody_summary(spark, d))


@query
def live_check(spark, d):
    log = A.advisory_log(spark, d).where("advisory_type = 'WQ'")
    return advisories.live_check(log, advisories.episodes(_storms(spark, d), _low_params(spark, d)))


@query
def observed_status(spark, d):
    log = A.advisory_log(spark, d).withColumn("poll_time_utc", F.date_trunc("day", "poll_time_utc"))
    return advisories.observed_status(log, log.where("duration_hr > 5"))


# Overflow volumes

@query
def cso_obs(spark, d):
    return cso.cso_observations(A.advisory_log(spark, d), A.POLL_ORDER)


def _states(spark, d):
    return cso.attach_storm_state(
        cso.cso_observations(A.advisory_log(spark, d), A.POLL_ORDER),
        params.gauge_map(A.waterbody_log(spark, d), A.POLL_ORDER), A.hourly(spark, d))


@query
def storm_so_far(spark, d):
    return _states(spark, d)


def _predictions(spark, d):
    return cso.predictions(_states(spark, d), params.cso_params(A.config(spark, d)))


@query
def cso_predictions(spark, d):
    return _predictions(spark, d).select(
        "waterbody", "occurred_on", "volume", F.round("pred_quadratic_depth_peak", 6).alias("pred_quadratic_depth_peak"),
        F.round("pred_poly5_depth", 6).alias("pred_poly5_depth"))


@query
def cso_scores(spark, d):
    return cso.scores(_predictions(spark, d))


@query
def cso_refit(spark, d):
    return cso.refit(_states(spark, d)).select("waterbody", "shape", "n", F.round("r2", 4).alias("r2"), F.round("rmse", 4).alias("rmse"))


# Filings

@query
def filing_dates(spark, d):
    return filings.with_dates(A.filings(spark, d)).select("sheet", "incident_id", "start", "start_dt")


@query
def duration_hours(spark, d):
    return filings.with_duration_hours(A.filings(spark, d)).select(
        "sheet", "incident_id", "duration", F.round("duration_hours", 6).alias("duration_hours"))


def _cleaned(spark, d):
    return filings.clean_filings(A.filings(spark, d))


@query
def filings_dedup(spark, d):
    return filings.export_columns(_cleaned(spark, d)).select(
        "sheet", "incident_id", "facility", "start_dt", F.round("duration_hours", 6).alias("duration_hours"))


@query
def nyc_subset(spark, d):
    return filings.city_subset(_cleaned(spark, d)).select("sheet", "incident_id", "facility", "county")


@query
def filing_coverage(spark, d):
    coverage = filings.filing_coverage(A.filings(spark, d), _cleaned(spark, d))
    return coverage.withColumn("duration_share", F.round("duration_share", 6))


# Filings against advisories

def _saved_episodes(spark, d):
    """Episodes as the written table they are in use, for queries that read them several times."""
    return pinned(_episodes(spark, d))


def _wet_filings(spark, d):
    return crosscheck.wet_weather_city_filings(_cleaned(spark, d))


@query
def filing_active(spark, d):
    return crosscheck.filings_active(_wet_filings(spark, d), _episodes(spark, d)).select("sheet", "incident_id", "start_dt")


@query
def filing_onset(spark, d):
    return crosscheck.filings_near_onset(_wet_filings(spark, d), _episodes(spark, d)).select("sheet", "incident_id", "start_dt")


@query
def filing_unmatched(spark, d):
    return crosscheck.filings_unmatched(_wet_filings(spark, d), _episodes(spark, d)).select("sheet", "incident_id", "start_dt")


@query
def filing_shares(spark, d):
    shares = crosscheck.match_shares(_wet_filings(spark, d), _saved_episodes(spark, d))
    return shares.select("filings", "active", "near_onset", F.round("active_share", 6).alias("active_share"),
                         F.round("near_onset_share", 6).alias("near_onset_share"))


@query
def onset_clusters(spark, d):
    return crosscheck.onset_clusters(_wet_filings(spark, d), _saved_episodes(spark, d), gap_hours=1, reach_hours=2)


@query
def cluster_match_rates(spark, d):
    clusters = crosscheck.onset_clusters(_wet_filings(spark, d), _saved_episodes(spark, d), gap_hours=1, reach_hours=2)
    rates = crosscheck.cluster_match_rates(clusters)
    return rates.withColumn("match_rate", F.round("match_rate", 6))


@query
def yearly_compare(spark, d):
    return crosscheck.yearly_compare(_wet_filings(spark, d), _saved_episodes(spark, d), gap_hours=1)


# Streams, each fed in several micro-batches whose rows don't follow time

@query
def stream_storms(spark, d):
    arriving, folder = A.landed(A.readings(spark, d), "occurred_on")
    readings = arriving.select("id", "sensor_id", F.col("occurred_on").alias("hour"), F.col("precip_in").alias("precip"))
    keep_storms(readings, f"{folder}/out", f"{folder}/state").awaitTermination()
    return current_storms(spark, f"{folder}/out")


@query
def stream_status(spark, d):
    rows = A.advisory_log(spark, d).select("waterbody", "advisory_type", "poll_time_utc", "poll_id", "occurred_on", "duration_hr")
    arriving, folder = A.landed(rows, "poll_time_utc")
    keys, order = ["waterbody", "advisory_type"], ["poll_time_utc", "poll_id"]
    polls.keep_state(arriving, keys, order, f"{folder}/out", f"{folder}/state").awaitTermination()
    return polls.current_state(spark, f"{folder}/out", keys, order, rows.schema)


@query
def stream_config(spark, d):
    # The poll id carries the revision, so that polls of the same time and id have an order.
    def build(lines):
        return A.as_config_polls(lines).withColumn("poll_id", F.col("poll_id") * 10 + F.col("revision")).drop("revision")

    arriving, folder = A.landed(A.config_lines(spark, d), "poll_time_utc", build=build)
    keep_config_changes(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return current_changes(spark, f"{folder}/out").select(
        "config_key", "poll_time_utc", F.floor(F.col("poll_id") / 10).alias("poll_id"))


@query
def stream_history(spark, d):
    history, batch = A.history_and_batch(spark, d)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # Rows of one id arrive together, so the first one is the same in every run.
    for rows in (history, batch):
        rows.repartition(2, "id").write.mode("append").parquet(f"{folder}/in")
        keep_history(A.stream_of(spark, history.schema, f"{folder}/in"), f"{folder}/history", f"{folder}/state").awaitTermination()
    return read_history(spark, f"{folder}/history", history.schema)


# Status views

@query
def last_samples(spark, d):
    return status.last_samples(A.dense_panel(spark, d))


@query
def rain_24(spark, d):
    return status.accumulated_rain(A.hourly(spark, d))


def _status(spark, d):
    return status.advisory_status(A.advisory_log(spark, d))


@query
def advisory_status(spark, d):
    return _status(spark, d).select("poll_id", "has_advisory", "until")


@query
def status_list(spark, d):
    named = _status(spark, d).withColumnRenamed("waterbody", "name")
    return status.status_list(named, " wb1", True).select("name", "poll_id", "until")


@query
def volume_class(spark, d):
    return A.advisory_log(spark, d).select("poll_id", status.volume_class(F.col("volume")).alias("volume_class"))


@query
def status_progress(spark, d):
    share = status.progress_percent(F.col("duration_hr"), F.col("advisory_type"))
    return A.advisory_log(spark, d).select("poll_id", F.round(share, 8).alias("progress"))


@query
def gauge_resolve(spark, d):
    return status.resolve_gauges(A.gauge_references(spark, d), A.gauges(spark, d))


@query
def nearest_volume(spark, d):
    found = nearest.nearest_waterbody(A.outfalls(spark, d), A.waterbody_points(spark, d))
    return found.select("outfall_id", "waterbody_id", F.round("distance_m", 2).alias("distance_m"), "volume")


@query
def nearest_outline(spark, d):
    found = nearest.nearest_waterbody(A.outfalls(spark, d), nearest.outline_segments(A.waterbody_outlines(spark, d)))
    return found.select("outfall_id", "waterbody_id", F.round("distance_m", 2).alias("distance_m"), "volume")


@query
def class_lookup(spark, d):
    info = status.water_class(F.col("wb_class"))
    return A.advisory_log(spark, d).select("poll_id", "wb_class", info["label"].alias("label"), info["description"].alias("description"))

"""Storm events: wet hours of one gauge separated by dry gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stormline.functions.clock import DAY, HOUR, cell_of, micros, stamp
from stormline.operators.panel import DEPTH
from stormline.operators.spans import fold_spans
from stormline.schemas import PRECIP

# The dry gap in hours that must be exceeded to end a storm.
WQ_GAP_HOURS = 6
CSO_GAP_HOURS = 4

CELL = 30 * DAY


def wet_hours(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("precip") > 0)


def storms(panel: DataFrame, gap_hours: int = WQ_GAP_HOURS, cell_length: int = CELL) -> DataFrame:
    """Start, end, depth and peak of every storm.

    A panel that carries ``near_null`` yields only storms clear of missing hours. Any
    hour within the gap of a storm is within the gap of one of its wet hours, so the
    flag of the wet hours decides and no range join is needed.
    """
    reliable_only = "near_null" in panel.columns
    rows = wet_hours(panel).select(
        "sensor_id", micros("hour").alias("_t"),
        F.col("precip").cast(DEPTH).alias("depth"), F.col("precip").alias("peak"),
        *([F.col("near_null").cast("int").alias("_near")] if reliable_only else []),
        *(["cell"] if "cell" in panel.columns else []),
    )
    measures = {"depth": "sum", "peak": "max"} | ({"_near": "max"} if reliable_only else {})
    folded = fold_spans(
        rows, ["sensor_id"], "_t", "_t", gap=gap_hours * HOUR, measures=measures,
        cell_length=cell_length, cell="cell" if "cell" in panel.columns else None,
    )
    if reliable_only:
        folded = folded.where(F.col("_near") == 0)
    return folded.select(
        "sensor_id", stamp("start_us").alias("start"), stamp("end_us").alias("end"),
        F.col("depth").cast(DEPTH).alias("depth"), F.col("peak").cast(PRECIP).alias("peak"))


def storm_state(
    panel: DataFrame,
    probes: DataFrame | None = None,
    gap_hours: int = WQ_GAP_HOURS,
    cell_length: int = CELL,
) -> DataFrame:
    """The storm in progress at each wet hour, or at each probe when probes are given.

    ``probes`` holds ``(sensor_id, hour)``. Rain up to and including the probe counts,
    and the last storm before it is used however old; with no rain before, depth and
    peak are 0 and ``storm_start`` is null.

    An as-of join without a join on time: wet hours and probes form one stream per
    (gauge, cell), and the state entering a cell is carried over one row per cell.
    """
    gap = gap_hours * HOUR
    stream = wet_hours(panel).select(
        "sensor_id", micros("hour").alias("_t"), F.col("precip").cast(DEPTH).alias("_rain"))
    if probes is not None:
        asked = probes.where(F.col("hour").isNotNull()).select("sensor_id", micros("hour").alias("_t")).distinct()
        stream = stream.unionByName(asked.withColumn("_rain", F.lit(None).cast(DEPTH)))
    group = ["sensor_id", "_cell"]
    wet = F.col("_rain").isNotNull()
    order = Window.partitionBy(*group).orderBy("_t", F.desc_nulls_last("_rain"))
    upto, before = (order.rowsBetween(Window.unboundedPreceding, stop) for stop in (0, -1))
    last_wet = F.last(F.when(wet, F.col("_t")), ignorenulls=True).over(before)
    opened = wet & (last_wet.isNull() | (F.col("_t") - last_wet > F.lit(gap)))
    in_storm = (
        Window.partitionBy(*group, "_nth").orderBy("_t", F.desc_nulls_last("_rain"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = (
        stream.withColumn("_cell", cell_of(F.col("_t"), cell_length))
        .withColumn("_nth", F.sum(opened.cast("long")).over(upto))
        .withColumn("_start", F.min(F.when(wet, F.col("_t"))).over(in_storm))
        .withColumn("_depth", F.coalesce(F.sum("_rain").over(in_storm), F.lit(0)).cast(DEPTH))
        .withColumn("_peak", F.coalesce(F.max("_rain").over(in_storm), F.lit(0)).cast(DEPTH))
    )
    carry = _carried_state(local, gap)
    # The storm at the head of a cell may be the tail of an earlier one.
    inherits = (F.col("_nth") == 0) | ((F.col("_nth") == 1) & F.col("c_joins"))
    zero = F.lit(0).cast(DEPTH)
    resolved = (
        local.where(wet if probes is None else ~wet)
        .join(carry, group, "left")
        .select(
            "sensor_id", stamp("_t").alias("hour"),
            F.col("_rain").cast(PRECIP).alias("precip"),
            stamp(F.when(inherits & F.col("c_start").isNotNull(), F.col("c_start"))
                  .otherwise(F.col("_start"))).alias("storm_start"),
            (F.col("_depth") + F.when(inherits, F.coalesce("c_depth", zero)).otherwise(zero))
            .cast(DEPTH).alias("depth"),
            F.greatest("_peak", F.when(inherits, F.coalesce("c_peak", zero)).otherwise(zero)).alias("peak"),
        )
    )
    return resolved if probes is None else resolved.drop("precip")


def _carried_state(local: DataFrame, gap: int) -> DataFrame:
    """Per cell, the storm state at its left border.

    A cell opens a new chain unless all its rain continues the storm before it; within
    a chain the tail states add up.
    """
    group = ["sensor_id", "_cell"]
    cells = local.groupBy(*group).agg(
        F.min(F.when(F.col("_rain").isNotNull(), F.col("_t"))).alias("_first"),
        F.max(F.when(F.col("_rain").isNotNull(), F.col("_t"))).alias("_last"),
        F.max("_nth").alias("_storms"),
        F.max(F.struct("_t", "_nth", "_start", "_depth", "_peak")).alias("_tail"),
    )
    by_gauge = Window.partitionBy("sensor_id").orderBy("_cell")
    earlier = F.last("_last", ignorenulls=True).over(by_gauge.rowsBetween(Window.unboundedPreceding, -1))
    joins = F.coalesce(F.col("_first") - earlier <= F.lit(gap), F.lit(False))
    breaks = (F.col("_storms") > 0) & ((F.col("_storms") > 1) | ~F.col("c_joins"))
    chain = (
        Window.partitionBy("sensor_id", "_chain").orderBy("_cell")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cells.withColumn("c_joins", joins)
        .withColumn("_chain", F.sum(breaks.cast("long")).over(by_gauge))
        .withColumn("_run", F.struct(
            F.min("_tail._start").over(chain).alias("start"),
            F.sum("_tail._depth").over(chain).cast(DEPTH).alias("depth"),
            F.max("_tail._peak").over(chain).alias("peak")))
        .withColumn("_in", F.lag("_run").over(by_gauge))
        .select(*group, "c_joins", F.col("_in.start").alias("c_start"),
                F.col("_in.depth").alias("c_depth"), F.col("_in.peak").alias("c_peak"))
    )


def storm_ids(panel: DataFrame, gap_hours: int = WQ_GAP_HOURS, cell_length: int = CELL) -> DataFrame:
    """Each wet hour with its storm, named by the storm's first wet hour."""
    return storm_state(panel, None, gap_hours, cell_length).select(
        "sensor_id", "hour", "precip", "storm_start")

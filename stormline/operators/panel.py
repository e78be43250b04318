"""Gauge readings, the hour-by-gauge panel and its quality control."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.functions.clock import DAY, HOUR, cell_of, micros, stamp
from stormline.operators.spans import fold_spans
from stormline.schemas import PRECIP

# Intermediate depth sums keep this scale, so threshold tests never meet float drift.
DEPTH = "decimal(18,4)"
MEDIAN = "decimal(18,5)"


@dataclass(frozen=True)
class QualityRules:
    """Fixed values of the quality rules, in inches and hours."""

    spike_over: str = "3.2"
    spike_others_under: str = "0.02"
    dead_own_under: str = "0.1"
    dead_others_over: str = "2.0"
    window_hours: int = 30 * 24
    margin_hours: int = 6

    @property
    def window(self) -> int:
        return self.window_hours * HOUR

    @property
    def margin(self) -> int:
        return self.margin_hours * HOUR

    @property
    def cell_length(self) -> int:
        """Cells are long against the halo, so few rows are copied."""
        return max(12 * (self.window + self.margin), 30 * DAY)


def dedup_hours(readings: DataFrame) -> DataFrame:
    """One reading per gauge and stamp: the one with the smallest id.

    An aggregate and not a ranked window, so copies are combined before the shuffle.
    """
    return (
        readings.where(F.col("occurred_on").isNotNull())
        .groupBy("sensor_id", F.col("occurred_on").alias("hour"))
        .agg(F.min(F.struct("id", "precip_in")).alias("_first"))
        .select("sensor_id", "hour", F.col("_first.precip_in").cast(PRECIP).alias("precip"))
    )


def panel_grid(hourly: DataFrame) -> DataFrame:
    """Every gauge at every stamp that any gauge reported; missing readings are null.

    Gauges are spread over the days of the record, and days are joined to their
    stamps, so the grid grows by an equi-join and each key stays one day wide.
    """
    hours = hourly.select("hour").distinct().withColumn("_day", cell_of(micros("hour"), DAY))
    first = hours.select(F.min("_day")).scalar()
    last = hours.select(F.max("_day")).scalar()
    gauges = hourly.select("sensor_id").distinct()
    spine = gauges.withColumn("_day", F.explode(F.sequence(first, last, F.lit(DAY))))
    cells = spine.join(hours, "_day").select("sensor_id", "hour")
    return cells.join(hourly, ["sensor_id", "hour"], "left").select("sensor_id", "hour", "precip")


def value_counts(panel: DataFrame) -> DataFrame:
    """Per hour, how many gauges show each reading; the base of every median."""
    return (
        panel.where(F.col("precip").isNotNull())
        .groupBy("hour", "precip").agg(F.count(F.lit(1)).alias("gauges"))
    )


def hour_centres(counts: DataFrame, suffix: str = "") -> DataFrame:
    """The middle order statistics of each hour, from its value counts.

    With n readings, leaving one out only ever needs the values ranked around n/2:
    ``mid_lo``/``mid_hi`` are the two middle values (equal when n is odd) and
    ``below``/``above`` their outer neighbours. No group of gauges is ever collected.
    """
    by_hour = Window.partitionBy("hour")
    upto = by_hour.orderBy("precip").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("_n", F.sum("gauges").over(by_hour))
        .withColumn("_cum", F.sum("gauges").over(upto))
    )

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") >= rank, F.col("precip")))

    low = F.floor((F.col("_n") + 1) / 2)
    high = F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy("hour").agg(
        F.max("_n").alias(f"n{suffix}"),
        at_rank(low).alias(f"mid_lo{suffix}"),
        at_rank(high).alias(f"mid_hi{suffix}"),
        F.max(F.when(F.col("_cum") - F.col("gauges") < low - 1, F.col("precip"))).alias(f"below{suffix}"),
        at_rank(high + 1).alias(f"above{suffix}"),
    )


def others_median(own: Column, suffix: str = "") -> Column:
    """Median of the other gauges at this hour, from the hour's centres and the own value."""
    n, lo, hi = (F.col(f"{name}{suffix}") for name in ("n", "mid_lo", "mid_hi"))
    below, above = F.col(f"below{suffix}"), F.col(f"above{suffix}")

    def mean(a: Column, b: Column) -> Column:
        return ((a.cast(DEPTH) + b.cast(DEPTH)) * F.lit("0.5").cast("decimal(2,1)")).cast(MEDIAN)

    odd = n % 2 == 1
    return (
        F.when(own.isNull(), mean(lo, hi))
        .when(n == 1, F.lit(None).cast(MEDIAN))
        .when(~odd & (own <= lo), hi.cast(MEDIAN))
        .when(~odd, lo.cast(MEDIAN))
        .when(own < lo, mean(lo, above))
        .when(own > lo, mean(below, lo))
        .otherwise(mean(below, above))
    )


def loo_median(panel: DataFrame) -> DataFrame:
    """Leave-one-out median of the other gauges for every cell of the panel."""
    centres = hour_centres(value_counts(panel))
    return panel.join(centres, "hour", "left").select(
        "sensor_id", "hour", "precip", others_median(F.col("precip")).alias("others"))


def is_spike(own: Column, others: Column, rules: QualityRules) -> Column:
    limit = F.lit(rules.spike_over).cast(DEPTH)
    quiet = F.lit(rules.spike_others_under).cast(MEDIAN)
    return F.coalesce((own > limit) & (others < quiet), F.lit(False))


def spike_repair(panel: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Zero the isolated spikes; ``others`` is the neighbours' median after the repair.

    A spike depends only on the hour and the value, so the repaired value counts come
    from the raw ones and the panel itself is joined once.
    """
    counts = value_counts(panel)
    raw = hour_centres(counts, "_raw")
    flagged = counts.join(raw, "hour").withColumn(
        "_spike", is_spike(F.col("precip"), others_median(F.col("precip"), "_raw"), rules))
    zero = F.lit(0).cast(PRECIP)
    repaired_counts = flagged.groupBy(
        "hour", F.when(F.col("_spike"), zero).otherwise(F.col("precip")).alias("precip")
    ).agg(F.sum("gauges").alias("gauges"))
    centres = raw.join(hour_centres(repaired_counts, "_fixed"), "hour")
    spike = is_spike(F.col("precip"), others_median(F.col("precip"), "_raw"), rules)
    return (
        panel.join(centres, "hour", "left")
        .withColumn("spike", spike)
        .withColumn("precip", F.when(F.col("spike"), zero).otherwise(F.col("precip")))
        .select("sensor_id", "hour", "precip", "spike",
                others_median(F.col("precip"), "_fixed").alias("others"))
    )


def _with_halo(df: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """Copy each row to every cell whose halo holds it, then group rows by gauge and cell."""
    t = micros("hour")
    first, last = cell_of(t - F.lit(after), length), cell_of(t + F.lit(before), length)
    return (
        df.withColumn("_t", t)
        .withColumn("cell", F.explode(F.sequence(first, last, F.lit(length))))
        .repartition("sensor_id", "cell")
    )


def _owned(df: DataFrame, length: int) -> DataFrame:
    return df.where(F.col("cell") == cell_of(F.col("_t"), length))


def _trailing_sums(haloed: DataFrame, window: int) -> DataFrame:
    """Sums of own and others over (t - window, t], null where nothing was reported.

    Each row enters once and leaves once, so the moving sum is a running sum in exact
    decimals: constant work per row instead of a scan of the whole window.
    """
    enter, leave = F.lit(1), F.lit(-1)
    events = haloed.withColumn("_sign", F.explode(F.array(leave, enter))).withColumn(
        "_at", F.when(F.col("_sign") == leave, F.col("_t") + F.lit(window)).otherwise(F.col("_t")))
    running = (
        Window.partitionBy("sensor_id", "cell").orderBy("_at", "_sign")
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def moving(name: str) -> Column:
        value = F.col(name).cast(MEDIAN)
        signed = F.when(F.col("_sign") == enter, value).otherwise(-value)
        present = F.when(F.col(name).isNotNull(), F.col("_sign")).otherwise(F.lit(0))
        total = F.sum(F.coalesce(signed, F.lit(0).cast(MEDIAN))).over(running).cast(MEDIAN)
        return F.when(F.sum(present).over(running) > 0, total)

    return (
        events.withColumn("own_sum", moving("precip"))
        .withColumn("others_sum", moving("others"))
        .where(F.col("_sign") == enter)
        .drop("_sign", "_at")
    )


def rolling_sums(repaired: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Trailing sums of the own and the neighbours' rain for every cell of the panel."""
    haloed = _with_halo(repaired, rules.window, 0, rules.cell_length)
    return _owned(_trailing_sums(haloed, rules.window), rules.cell_length).select(
        "sensor_id", "hour", "precip", "own_sum", "others_sum")


def _dead(rules: QualityRules) -> Column:
    own = F.col("own_sum") < F.lit(rules.dead_own_under).cast(DEPTH)
    others = F.col("others_sum") > F.lit(rules.dead_others_over).cast(DEPTH)
    return F.coalesce(own & others, F.lit(False))


def dead_flags(repaired: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Hours at which a gauge looks dead over the trailing window."""
    return rolling_sums(repaired, rules).withColumn("dead", _dead(rules))


def _nearest(flag: Column, forward: bool) -> Column:
    """Stamp of the nearest flagged row at or after (at or before) this one."""
    order = F.col("_t").desc() if forward else F.col("_t").asc()
    frame = Window.partitionBy("sensor_id", "cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(flag, F.col("_t")), ignorenulls=True).over(frame)


def mask_dead(repaired: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Null every hour of a dead window and mark the hours next to a null.

    A flag masks the window before it. Sums, masks and margins share one shuffle by
    gauge and cell, with a halo of one window and one margin on both sides; the
    ``cell`` column lets storms be folded on the same partitioning.
    """
    reach = rules.window + rules.margin
    haloed = _with_halo(repaired, reach, reach, rules.cell_length)
    flagged = _trailing_sums(haloed, rules.window).withColumn("dead", _dead(rules))
    masked = flagged.withColumn(
        "masked", F.coalesce(_nearest(F.col("dead"), True) - F.col("_t") < F.lit(rules.window), F.lit(False))
    ).withColumn("precip", F.when(~F.col("masked"), F.col("precip")))
    return _owned(_mark_near_null(masked, rules.margin), rules.cell_length).select(
        "sensor_id", "hour", "precip", "masked", "near_null", "cell")


def _mark_near_null(haloed: DataFrame, margin: int) -> DataFrame:
    gone = F.col("precip").isNull()
    ahead = _nearest(gone, True) - F.col("_t") <= F.lit(margin)
    behind = F.col("_t") - _nearest(gone, False) <= F.lit(margin)
    return haloed.withColumn(
        "near_null", F.coalesce(ahead, F.lit(False)) | F.coalesce(behind, F.lit(False)))


def mark_near_null(panel: DataFrame, margin_hours: int = 6, cell_length: int = 90 * DAY) -> DataFrame:
    """Mark hours with a null reading of the same gauge within the margin, both ends inclusive."""
    margin = margin_hours * HOUR
    return _owned(
        _mark_near_null(_with_halo(panel, margin, margin, cell_length), margin), cell_length
    ).select("sensor_id", "hour", "precip", "near_null", "cell")


def quality_control(panel: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Spikes zeroed, then dead windows masked, both for all gauges at once."""
    return mask_dead(spike_repair(panel, rules), rules)


def reliable_hours(panel: DataFrame) -> DataFrame:
    return panel.groupBy("sensor_id").agg(F.count("precip").alias("reliable_hours"))


def outages(controlled: DataFrame) -> DataFrame:
    """Runs of masked hours per gauge."""
    masked = controlled.where("masked").select("sensor_id", micros("hour").alias("_t"), F.lit(1).cast("long").alias("hours"))
    runs = fold_spans(masked, ["sensor_id"], "_t", "_t", gap=HOUR, measures={"hours": "sum"})
    return runs.select("sensor_id", stamp("start_us").alias("start"), stamp("end_us").alias("end"), "hours")


def outage_days(controlled: DataFrame, k: int | None = None) -> DataFrame:
    """Masked time per gauge, longest first; ``k`` keeps the head of the ranking."""
    ranked = (
        outages(controlled).groupBy("sensor_id")
        .agg(F.sum("hours").alias("masked_hours"), F.count(F.lit(1)).alias("outages"),
             F.max("hours").alias("longest_hours"))
        .withColumn("outage_days", F.col("masked_hours") / 24.0)
        .orderBy(F.desc("masked_hours"), "sensor_id")
    )
    return ranked if k is None else ranked.limit(k)

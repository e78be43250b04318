"""Storms of a stream of readings that come in any order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from stormline.functions.clock import HOUR, cell_of, micros, stamp
from stormline.operators.panel import DEPTH
from stormline.operators.spans import join_cells
from stormline.operators.storms import CELL, WQ_GAP_HOURS
from stormline.schemas import PRECIP
from stormline.streaming.cells import CellProcessor, current_cells, keep_cells, struct

KEYS = ["sensor_id", "cell"]
RAIN = T.DecimalType(12, 4)
PIECE = struct(start_us=T.LongType(), end_us=T.LongType(), depth=T.DecimalType(18, 4), peak=RAIN)
PIECES = struct(sensor_id=T.StringType(), cell=T.LongType(), pieces=T.ArrayType(PIECE))


class StormCells(CellProcessor):
    """The storms inside a gauge's cell; of several readings of an hour the one with the smallest id counts."""

    keys = KEYS
    place_schema = struct(at=T.LongType())
    value_schema = struct(id=T.StringType(), precip=RAIN)

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def entry(self, row: Row) -> tuple[tuple, tuple]:
        return (row["at"],), (row["id"], row["precip"])

    def better(self, value: tuple, held: tuple) -> bool:
        return value[0] < held[0]

    def pieces(self, ordered) -> list:
        found: list[list] = []
        for (at,), (_, precip) in ordered:
            if precip is None or precip <= 0:
                continue
            if found and at - found[-1][1] <= self.gap_us:
                last = found[-1]
                last[1], last[2], last[3] = at, last[2] + precip, max(last[3], precip)
            else:
                found.append([at, at, Decimal(0) + precip, precip])
        return [Row(start_us=a, end_us=b, depth=c, peak=d) for a, b, c, d in found]


def keep_storms(readings: DataFrame, out: str, checkpoint: str, gap_hours: int = WQ_GAP_HOURS,
                cell_length: int = CELL) -> StreamingQuery:
    """Fold a stream of readings (``id, sensor_id, hour, precip``) into the storms of each gauge and cell.

    The rule for repeated hours comes first, in the state of the cell: an id that is smaller
    than the one held replaces its reading, whenever it comes. Rows without gauge, hour or
    id are no readings.
    """
    rows = readings.where("sensor_id is not null and hour is not null and id is not null").select(
        "sensor_id", cell_of(micros("hour"), cell_length).alias("cell"), micros("hour").alias("at"),
        F.col("id").cast("string").alias("id"), F.col("precip").cast(PRECIP).alias("precip"))
    return keep_cells(rows, StormCells(gap_hours * HOUR), PIECES, out, checkpoint)


def current_storms(spark: SparkSession, out: str, gap_hours: int = WQ_GAP_HOURS) -> DataFrame:
    """All storms so far, open ones included: what the batch operator gives for the same readings in any order.

    Reads storms and not readings; only the first and last storm of a cell can be part of another.
    """
    pieces = current_cells(spark, out, KEYS, PIECES).where(F.size("pieces") > 0).select(
        "sensor_id", F.col("cell").alias("_cell"), F.size("pieces").alias("_of"), F.posexplode("pieces").alias("_at", "_p"))
    inside = pieces.select("sensor_id", "_cell", (F.col("_at") + 1).alias("_nth"), "_of", F.col("_p.start_us").alias("_start"),
                           F.col("_p.end_us").alias("_end"), F.col("_p.depth").alias("depth"), F.col("_p.peak").alias("peak"))
    whole = join_cells(inside, ["sensor_id"], gap_hours * HOUR, {"depth": "sum", "peak": "max"})
    return whole.select("sensor_id", stamp("start_us").alias("start"), stamp("end_us").alias("end"),
                        F.col("depth").cast(DEPTH).alias("depth"), F.col("peak").cast(PRECIP).alias("peak"))

"""Ordered state per key and calendar cell, for streams whose rows come in any order.

Each cell keeps its rows in order in Spark's state store and, whenever a row is new to it,
emits its whole summary anew. A late row thus lands between its neighbours and no
watermark drops it; a summary is bounded by the calendar, and so is the state of a key that
holds a third of all rows, as that is spread over its cells. What crosses a cell border is
settled when the summaries are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stormline.sources.ledger import append_batch, read_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the store of Spark that holds ordered and keyed state.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@contextmanager
def keyed_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class CellProcessor(StatefulProcessor):
    """Keeps one value per place in a cell and emits ``pieces``, a summary of all of them.

    Subclasses say what a row's place and value are, which of two values of a place stays,
    and how the ordered values are summed up.
    """

    keys: Sequence[str]
    place_schema: T.StructType
    value_schema: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("held", T.StructType([*self.place_schema.fields, *self.value_schema.fields]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[tuple, tuple] = {}
        for row in rows:
            place, value = self.entry(row)
            if place not in fresh or self.better(value, fresh[place]):
                fresh[place] = value
        width = len(self.place_schema)
        held = {tuple(entry[:width]): tuple(entry[width:]) for entry in self._held.get()}
        added = {place: value for place, value in fresh.items() if place not in held}
        replaced = {place: value for place, value in fresh.items() if place in held and self.better(value, held[place])}
        held |= added | replaced
        # The store is asked once and told once a cell, whatever the number of its rows.
        if replaced:
            self._held.put([(*place, *value) for place, value in held.items()])
        elif added:
            self._held.appendList([(*place, *value) for place, value in added.items()])
        if added or replaced:
            yield Row(**dict(zip(self.keys, key)), pieces=self.pieces(sorted(held.items())))

    def close(self) -> None:
        pass

    def entry(self, row: Row) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def better(self, value: tuple, held: tuple) -> bool:
        raise NotImplementedError

    def pieces(self, ordered: Sequence[tuple[tuple, tuple]]) -> list:
        raise NotImplementedError


def keep_cells(rows: DataFrame, processor: CellProcessor, schema: T.StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Start the stream: summaries of the cells that a micro-batch changed go to the log ``out``.

    A micro-batch that runs again after a failure replaces its own rows.
    """
    changes = rows.groupBy(*processor.keys).transformWithState(processor, schema, "Update", "None")
    return keep_batches(changes, out, checkpoint, "update")


def keep_batches(changes: DataFrame, out: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write every micro-batch of ``changes`` to a log of batches."""
    with keyed_store(changes.sparkSession):
        return (changes.writeStream.foreachBatch(lambda batch, number: append_batch(batch, out, number)).outputMode(mode)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_cells(spark: SparkSession, out: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """The newest summary of every cell, as keys and ``pieces``."""
    return read_batches(spark, out, schema).groupBy(*keys).agg(F.max_by("pieces", "batch").alias("pieces"))

"""Ordered work on one key without putting the whole key into one task.

A gauge or waterbody may hold a large share of all rows, so no window here is
partitioned by the entity alone. Rows are first grouped by entity *and* calendar
cell. What crosses a cell border is then settled on a handful of rows per cell, whose
number is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.functions.clock import DAY, cell_of

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def fold_spans(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    gap: int = 0,
    measures: Mapping[str, str] | None = None,
    cell_length: int = 30 * DAY,
    cell: str | None = None,
    combine: bool = False,
) -> DataFrame:
    """Merge spans of the same key that lie at most ``gap`` microseconds apart.

    ``start`` and ``end`` are long columns of epoch microseconds; pass the same column
    twice to fold points into sessions. ``measures`` maps a column to ``sum``, ``max``
    or ``min``. ``cell`` names an existing column equal to the cell of each point,
    whose partitioning is then used as it is. ``combine`` keeps the longest span per
    start before the shuffle, for many keys folded into one.

    Pass one folds inside each (key, cell). Only the first and the last result of a
    cell can touch another cell, so pass two re-folds those alone under a common key;
    every other result is already final and stays spread over its cells.
    """
    measures = dict(measures or {})
    points = start == end
    if not points and any(kind == "sum" for kind in measures.values()):
        raise ValueError("spans may be cut at cell borders, so they cannot be summed")
    carried = list(measures)
    base = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if combine:
        base = base.groupBy(*keys, start).agg(
            F.max(end).alias(end) if not points else F.count(F.lit(1)).alias("_n"),
            *[_FOLD[kind](name).alias(name) for name, kind in measures.items()],
        )
    if points:
        home = F.col(cell) if cell else cell_of(F.col(start), cell_length)
        pieces = base.select(
            *keys, home.alias("_cell"), F.col(start).alias("_start"), F.col(end).alias("_end"), *carried)
    else:
        covered = F.sequence(
            cell_of(F.col(start), cell_length), cell_of(F.col(end), cell_length), F.lit(cell_length))
        pieces = base.select(
            *keys, F.col(start).alias("_from"), F.col(end).alias("_to"), *carried,
            F.explode(covered).alias("_cell"),
        ).select(
            *keys, "_cell",
            F.greatest("_from", "_cell").alias("_start"),
            F.least("_to", F.col("_cell") + F.lit(cell_length)).alias("_end"),
            *carried,
        )
    return join_cells(_fold_within(pieces, keys, gap, measures), keys, gap, measures)


def join_cells(inside: DataFrame, keys: Sequence[str], gap: int, measures: Mapping[str, str]) -> DataFrame:
    """Fold spans that are already folded inside each cell; ``_nth`` of ``_of`` numbers them there from 1."""
    carried = list(measures)
    on_border = (F.col("_nth") == 1) | (F.col("_nth") == F.col("_of"))
    borders = inside.select(
        *keys, F.when(~on_border, F.col("_cell")).alias("_cell"), "_start", "_end", *carried)
    return _fold_within(borders, keys, gap, measures).select(
        *keys, F.col("_start").alias("start_us"), F.col("_end").alias("end_us"), *carried)


def _fold_within(df: DataFrame, keys: Sequence[str], gap: int, measures: Mapping[str, str]) -> DataFrame:
    group = [*keys, "_cell"]
    ordered = Window.partitionBy(*group).orderBy("_start", "_end")
    reach = F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("_start") - reach > F.lit(gap))
    return (
        df.withColumn("_fresh", fresh.cast("long"))
        .withColumn("_nth", F.sum("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_of", F.max("_nth").over(Window.partitionBy(*group)))
        .groupBy(*group, "_nth", "_of")
        .agg(
            F.min("_start").alias("_start"), F.max("_end").alias("_end"),
            *[_FOLD[kind](name).alias(name) for name, kind in measures.items()],
        )
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at: str,
    values: Sequence[str],
    *,
    cell_length: int = 30 * DAY,
) -> DataFrame:
    """Add ``prev_<value>``, the values of the row before by ``order`` within each key.

    ``at`` is the leading order column, in epoch microseconds. The lag runs inside a
    (key, cell). Only the first row of a cell looks further back: first and last rows,
    two per cell, are lined up by key alone. Both parts read the same shuffle.
    """
    group = [*keys, "_cell"]
    ordered = Window.partitionBy(*group).orderBy(*order)
    local = (
        df.withColumn("_cell", cell_of(F.col(at), cell_length))
        .withColumn("_held", F.struct(*values))
        .withColumn("_before", F.lag("_held").over(ordered))
        .withColumn("_next", F.lead("_held").over(ordered))
    )
    inner = local.where(F.col("_before").isNotNull()).drop("_next")
    along = Window.partitionBy(*keys).orderBy("_cell", *order)
    borders = local.where(F.col("_before").isNull() | F.col("_next").isNull()).withColumn(
        "_earlier", F.lag("_held").over(along))
    heads = borders.where(F.col("_before").isNull()).drop("_before", "_next").withColumnRenamed("_earlier", "_before")
    return inner.unionByName(heads).select(
        *df.columns, *[F.col("_before").getField(v).alias(f"prev_{v}") for v in values])


def bucketed(spans: DataFrame, start: str, end: str, length: int = DAY) -> DataFrame:
    """One row per calendar bucket that a span touches, in column ``_bucket``."""
    covered = F.sequence(cell_of(F.col(start), length), cell_of(F.col(end), length), F.lit(length))
    return spans.withColumn("_bucket", F.explode(covered))


def match_spans(
    points: DataFrame,
    at: str | Column,
    spans: DataFrame,
    *,
    keys: Sequence[str] = (),
    how: str = "left_semi",
    length: int = DAY,
) -> DataFrame:
    """Join points to the span that holds them, both ends inclusive.

    ``spans`` must be folded (disjoint within a key), with ``start_us`` and ``end_us``:
    a bucket then holds few spans and a point meets at most one. An equi-join on the
    bucket with an exact filter replaces the range join.
    """
    t = F.col(at) if isinstance(at, str) else at
    left = points.withColumn("_t", t).withColumn("_bucket", cell_of(F.col("_t"), length))
    right = bucketed(spans, "start_us", "end_us", length)
    right = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
        *[c for c in right.columns if c not in (*keys, "_bucket")])
    condition = (F.col("_bucket") == F.col("_b")) & (F.col("_t") >= F.col("start_us")) & (
        F.col("_t") <= F.col("end_us"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_k_{k}"))
    joined = left.join(right, condition, how)
    return joined.drop("_t", "_bucket", "_b", *[f"_k_{k}" for k in keys])

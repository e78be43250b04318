"""Time arithmetic on epoch microseconds.

Range frames, gaps and calendar cells are all plain long arithmetic, so they stay
inside generated code and never depend on a calendar library.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(name: str | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.unix_micros(col.cast("timestamp"))


def stamp(name: str | Column) -> Column:
    return F.timestamp_micros(F.col(name) if isinstance(name, str) else name)


def cell_of(t: Column, length: int) -> Column:
    """Start of the calendar cell holding ``t``; exact for stamps before 1970 too."""
    return t - F.pmod(t, F.lit(length))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR))


def tolerant_timestamp(text: Column) -> Column:
    """ISO text to a stamp; a trailing zone mark is dropped and bad text is null."""
    bare = F.replace(text, F.lit("Z"), F.lit(""))
    return F.try_to_timestamp(bare)

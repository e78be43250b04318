"""Free-text dates, durations and keyword matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as white space around a text: every blank of Unicode and the ASCII separators.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The shapes of a duration that is understood, with a unit and without.
DURATION_WITH_UNIT = r"^(\d+(?:\.\d+)?)\s*(hour|hr|minute|min|day)"
DURATION_BARE = r"^(\d+(?:\.\d+)?)$"

# Words that stand for an unknown duration.
UNKNOWN_DURATIONS = ["", "nan", "none", "unknown", "tbd"]

# The date formats seen in filings, each with the shape of text it fits. The US
# forms come first, then the free forms; other text is null and is counted.
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
]


def strip(text: Column) -> Column:
    """The text without white space at its ends, tabs and line ends included."""
    return F.btrim(text.cast("string"), F.lit(WHITE_SPACE))


def parse_filing_date(text: Column) -> Column:
    """ISO (also compact), then the US forms, then the free forms; otherwise null.

    A format is tried only on text of its shape: a failed parse costs far more than a
    pattern test.
    """
    trimmed = strip(text)
    # A cast also takes a bare year or year-month, and times without a date; a dash after
    # a four-digit year keeps those last ones out.
    iso = F.when(trimmed.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?$"), trimmed.try_cast("timestamp"))
    compact = F.when(trimmed.rlike(r"^\d{8}$"), F.try_to_timestamp(trimmed, F.lit("yyyyMMdd")))
    others = [F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(form))) for shape, form in DATE_FORMATS]
    return F.coalesce(iso, compact, *others)


def parse_duration_hours(text: Column) -> Column:
    """'24 Hours', '15 Minutes', '2 Days' or a bare number of hours; otherwise null."""
    cleaned = F.lower(strip(text))
    number = F.regexp_extract(cleaned, DURATION_WITH_UNIT, 1).try_cast("double")
    unit = F.regexp_extract(cleaned, DURATION_WITH_UNIT, 2)
    bare = F.regexp_extract(cleaned, DURATION_BARE, 1).try_cast("double")
    return (
        F.when(cleaned.isin(UNKNOWN_DURATIONS), F.lit(None).cast("double"))
        .when(unit.startswith("min"), number / 60)
        .when(unit == "day", number * 24)
        .when(unit != "", number)
        .otherwise(bare)
    )


def contains_keyword(name: Column, keyword: str) -> Column:
    """Any-case substring test; a blank keyword keeps every row."""
    wanted = keyword.strip().lower()
    return F.lit(True) if not wanted else F.lower(name).contains(wanted)

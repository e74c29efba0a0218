"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    """The Monday of the week, as a date."""
    day = F.to_date(ts)
    return F.date_sub(day, F.weekday(day))


def iso_utc(text: Column) -> Column:
    """Parse an ISO date-time as UTC wall time; an offset or Z is cut off, not applied.

    Anything else is null.
    """
    wall = F.regexp_extract(
        text,
        r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)"
        r"(?:Z*|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$",
        1,
    )
    seconds = (
        F.when(F.length(wall) == 10, F.concat(wall, F.lit("T00:00:00")))
        .when(F.length(wall) == 16, F.concat(wall, F.lit(":00")))
        .when(wall != "", F.replace(wall, F.lit(","), F.lit(".")))
    )
    return F.try_to_timestamp(F.concat(seconds, F.lit("Z")))


def epoch_utc(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; null, zero and out-of-range values are null."""
    value = seconds.try_cast("bigint")
    # years 1 to 9999
    return F.when((value != 0) & value.between(-62135596800, 253402300799), F.timestamp_seconds(value))

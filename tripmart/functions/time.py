"""Calendar and duration expressions.

Canonical trip times are ``timestamp_ntz`` (the warehouse's plain
``timestamp`` is zone-less), so every expression here is independent of the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def _clock(ts: Column, unit: str) -> Column:
    """Whole units elapsed since midnight (wall clock, no zone involved)."""
    if unit == "hour":
        return F.hour(ts)
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return minutes if unit == "minute" else minutes * 60 + F.second(ts)


def boundary_diff(unit: str, start, end) -> Column:
    """``DATEDIFF(unit, start, end)`` as a count of unit boundaries crossed.

    00:00:59 -> 00:01:01 is 1 minute, where elapsed-time functions give 0.
    Built from calendar fields only (day difference plus the clock reading
    truncated to the unit), so it is exact and never depends on the session
    time zone, which elapsed-time functions on zone-less values do.
    """
    unit = unit.lower()
    a, b = col_of(start), col_of(end)
    per_day = 86400 // _UNIT_SECONDS[unit]
    days = F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    return days * per_day + (_clock(b, unit) - _clock(a, unit)).cast("long")


def minutes_between(start, end) -> Column:
    """``DATEDIFF('minute', start, end)``."""
    return boundary_diff("minute", start, end)


def seconds_between(start, end) -> Column:
    """``DATEDIFF('second', start, end)``."""
    return boundary_diff("second", start, end)


def hour_of(ts) -> Column:
    """``EXTRACT(HOUR FROM ts)``."""
    return F.hour(col_of(ts))


def day_name(ts) -> Column:
    """``TO_CHAR(ts, 'DY')`` -> ``Sun`` .. ``Sat``."""
    return F.date_format(col_of(ts), "E")


def is_weekend(ts) -> Column:
    """``IFF(DAYOFWEEK(ts) IN (0, 6), TRUE, FALSE)``; a NULL time gives false.

    The warehouse numbers Sunday 0 .. Saturday 6; Spark numbers Sunday 1 ..
    Saturday 7.
    """
    return F.coalesce(F.dayofweek(col_of(ts)).isin(1, 7), F.lit(False))


def date_of(ts) -> Column:
    """``TO_DATE(ts)``."""
    return F.to_date(col_of(ts))

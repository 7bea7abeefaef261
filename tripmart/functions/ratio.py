"""Guarded ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of


def tip_pct(tip="tip_amount", fare="fare_amount") -> Column:
    """``tip / NULLIFZERO(fare)``; NULL when the fare is 0 or NULL."""
    return col_of(tip) / F.nullifzero(col_of(fare))


def speed_mph(distance, seconds) -> Column:
    """F8: ``distance / NULLIF(seconds / 3600.0, 0)``; NULL for 0 seconds."""
    hours = F.nullif(col_of(seconds), F.lit(0)).cast("double") / F.lit(3600.0)
    return col_of(distance) / hours


def iff(cond: Column, a, b) -> Column:
    """``IFF(cond, a, b)``; a NULL condition takes the else branch."""
    return F.when(cond, a).otherwise(b)


def round_to(c, digits: int) -> Column:
    """``ROUND(x, n)``, half away from zero."""
    return F.round(col_of(c), digits)

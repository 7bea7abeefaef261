"""Warehouse-style casts (F11, F14) used by the schema pick.

``number`` is NUMBER(38,0): fractions round half away from zero, so doubles go
through ``round`` before the integral cast.  The canonical columns hold it as long;
values beyond that are NULL there and go to the rejects of the load (``ingest.rejects``).
``to_number38`` keeps all 38 digits.  ``varchar`` of a float prints an
integral value without a fraction (1.0 -> '1').  Code columns stored as text
are matched to integer dimension keys through a tolerant numeric parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import col_of

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def to_number(c, dtype: T.DataType) -> Column:
    """``x::number`` -> long; bad values give NULL rather than failing a job."""
    c = col_of(c)
    if isinstance(dtype, _INTEGRAL):
        return c.cast("long")
    if isinstance(dtype, _FRACTIONAL):
        return F.round(c).try_cast("long")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("long")
    return F.round(c.try_cast("decimal(38,18)")).try_cast("long")


def to_number38(c, dtype: T.DataType) -> Column:
    """``x::number`` with all its 38 digits -> decimal(38,0), halves rounded away from zero."""
    c = col_of(c)
    if isinstance(dtype, _INTEGRAL):
        return c.cast("decimal(38,0)")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("decimal(38,0)")
    # beyond 20 digits before the point, the plain cast rounds the same way
    return F.coalesce(F.round(c.try_cast("decimal(38,18)")).try_cast("decimal(38,0)"), c.try_cast("decimal(38,0)"))


def to_float(c, dtype: T.DataType) -> Column:
    """``x::float`` -> double."""
    c = col_of(c)
    if isinstance(dtype, (T.StringType,)):
        return c.try_cast("double")
    return c.cast("double")


def to_varchar(c, dtype: T.DataType) -> Column:
    """``x::varchar`` -> string; 1.0 prints as '1', 1.5 as '1.5'."""
    c = col_of(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")) \
                .otherwise(d.cast("string"))
    if isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


def to_timestamp_ntz(c, dtype: T.DataType) -> Column:
    """``x::timestamp`` (zone-less)."""
    c = col_of(c)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.StringType):
        return c.try_cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        # the UTC clock reading, whatever the session's zone
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


CASTS = {
    "number": to_number,
    "float": to_float,
    "varchar": to_varchar,
    "timestamp": to_timestamp_ntz,
    "int": lambda c, t: to_number(c, t).cast("int"),
}

SPARK_TYPE = {
    "number": "long",
    "float": "double",
    "varchar": "string",
    "timestamp": "timestamp_ntz",
    "int": "int",
}


def code_key(code) -> Column:
    """Integer key of a text code for a join with an int dimension.

    '1', '1.0' -> 1; 'CMT', '' or NULL -> NULL (no match, description NULL).
    """
    return col_of(code).try_cast("decimal(38,0)").try_cast("int")


def typed_null(kind: str) -> Column:
    """``NULL::<kind>``."""
    return F.lit(None).cast(SPARK_TYPE[kind])

"""The warehouse functions of the source's SQL as Spark SQL functions.

Registered per session as SQL-bodied temporary functions, which the analyzer
inlines: they stay JVM-side and inside whole-stage codegen like the Column
functions of this package (and a test checks both give the same values).
A user's report SQL then ports with renames only:

  DATEDIFF('minute', a, b)   -> datediff_boundary('minute', a, b)
  TO_CHAR(ts, 'DY')          -> day_abbrev(ts)
  DAYOFWEEK(ts) (Sunday = 0) -> dayofweek_sun0(ts)
  IFF(c, a, b)               -> if(c, a, b)           (Spark built-in)
  NULLIFZERO(x)              -> nullifzero(x)         (Spark built-in)
  QUALIFY rn <= k            -> WHERE rn <= k in an outer query
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "datediff_boundary": """
        (unit STRING, a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BIGINT RETURN
        CASE lower(unit)
          WHEN 'minute' THEN CAST(datediff(to_date(b), to_date(a)) AS BIGINT) * 1440
                             + ((hour(b) * 60 + minute(b)) - (hour(a) * 60 + minute(a)))
          WHEN 'second' THEN CAST(datediff(to_date(b), to_date(a)) AS BIGINT) * 86400
                             + ((hour(b) * 3600 + minute(b) * 60 + second(b))
                                - (hour(a) * 3600 + minute(a) * 60 + second(a)))
          WHEN 'hour'   THEN CAST(datediff(to_date(b), to_date(a)) AS BIGINT) * 24
                             + (hour(b) - hour(a))
          WHEN 'day'    THEN CAST(datediff(to_date(b), to_date(a)) AS BIGINT)
        END""",
    "day_abbrev": "(ts TIMESTAMP_NTZ) RETURNS STRING RETURN date_format(ts, 'E')",
    "dayofweek_sun0": "(ts TIMESTAMP_NTZ) RETURNS INT RETURN dayofweek(ts) - 1",
    "is_weekend": ("(ts TIMESTAMP_NTZ) RETURNS BOOLEAN RETURN "
                   "coalesce(dayofweek(ts) IN (1, 7), false)"),
    "tip_pct": "(tip DOUBLE, fare DOUBLE) RETURNS DOUBLE RETURN tip / nullifzero(fare)",
    "speed_mph": ("(distance DOUBLE, seconds BIGINT) RETURNS DOUBLE RETURN "
                  "distance / (CAST(nullif(seconds, 0) AS DOUBLE) / 3600.0D)"),
    "code_key": ("(code STRING) RETURNS INT RETURN "
                 "try_cast(try_cast(code AS DECIMAL(38,0)) AS INT)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in this session; returns their names."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(_FUNCTIONS)

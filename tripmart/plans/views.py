"""The warehouse view chain as session views.

Registers every relation the source's SQL reads, under its table name:
``trips_all``, ``obt_trips_v``, ``obt_trips_clean_v`` (created from SQL
text), ``obt_trips``, ``taxi_zones``, ``payment_type_dim``,
``rate_code_dim``, ``vendor_dim`` and ``obt_trips_enriched``.  Reports
written as SQL strings then run against the same plans as the DataFrame
reports.  Spark SQL has no QUALIFY: filter a ROW_NUMBER column in a
subquery instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import marts
from ..operators.dims import Dims
from ..sources.catalog import read_query  # noqa: F401  (re-exported)


def _between(column: str, bounds: tuple) -> str:
    return f"{column} BETWEEN {bounds[0]} AND {bounds[1]}"


#: The clean rule as SQL text, from the bounds that the DataFrame rule uses.
CLEAN_VIEW_SQL = f"""
CREATE OR REPLACE TEMP VIEW obt_trips_clean_v AS SELECT * FROM obt_trips_v
WHERE {_between("trip_minutes", marts.CLEAN_MINUTES)} AND {_between("tip_pct", marts.CLEAN_TIP_SHARE)}
  AND trip_distance > 0 AND trip_distance <= {marts.CLEAN_MAX_DISTANCE}"""

CODE_VIEWS = {"payment": "payment_type_dim", "rate": "rate_code_dim", "vendor": "vendor_dim"}


def register_views(spark: SparkSession, trips_all: DataFrame, dims: Dims | None = None) -> None:
    trips_all.createOrReplaceTempView("trips_all")
    marts.obt(trips_all).createOrReplaceTempView("obt_trips_v")
    spark.sql(CLEAN_VIEW_SQL)
    strict = marts.strict(trips_all)
    strict.createOrReplaceTempView("obt_trips")
    if dims is not None:
        dims.zones.createOrReplaceTempView("taxi_zones")
        for role, name in CODE_VIEWS.items():
            dims.codes[role].createOrReplaceTempView(name)
        marts.enrich(strict, dims).createOrReplaceTempView("obt_trips_enriched")

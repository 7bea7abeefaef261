"""Catalog inventory (S6, W4) and generic query reads.

Raw months registered as tables ``TRIPS_<SERVICE>_<YYYY>_<MM>`` are found by
listing the catalog (``SHOW TABLES`` is already a DataFrame) and parsing the
names with an anchored pattern; anything else (samples such as
``..._TINY``, the unified ``TRIPS_ALL``) is not a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import TABLE_PATTERN, extract_int, extract_str
from ..sinks.monthly import quote


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of a database's tables and views; without one, also of the session's temporary views."""
    found = spark.sql(f"SHOW TABLES IN {database}").where("NOT isTemporary") if database else spark.sql("SHOW TABLES")
    return found.select(F.col("tableName").alias("table_name"))


def parse_table_names(names: DataFrame, column: str = "table_name") -> DataFrame:
    """(table_name, service_type, yr, mo) for names that are raw months."""
    n = F.col(column)
    out = names.select(
        n.alias("table_name"),
        F.lower(extract_str(n, TABLE_PATTERN, 1)).alias("service_type"),
        extract_int(n, TABLE_PATTERN, 2).alias("yr"),
        extract_int(n, TABLE_PATTERN, 3).alias("mo"),
    )
    return (out.where(F.col("yr").isNotNull() & F.col("mo").isNotNull())
            .orderBy("service_type", "yr", "mo"))


def register_months(spark: SparkSession, database: str, units, scans: dict) -> list[str]:
    """Every month unit as an external table ``TRIPS_<SERVICE>_<YYYY>_<MM>`` of ``database``;
    nothing is copied.  ``units`` are rows of ``files.month_units``, ``scans`` their schemas."""
    names = []
    for u in units:
        (path, schema), = scans[u["unit"]]
        name = f"{database}.TRIPS_{u['service_type'].upper()}_{u['year']}_{u['month']:02d}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION {quote(path)}")
        names.append(name)
    return names


def inventory_months(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The raw months registered in a catalog database."""
    return parse_table_names(catalog_tables(spark, database))


def read_query(spark: SparkSession, sql: str, fmt: str | None = None,
               **options) -> DataFrame:
    """S3: a query read.  With ``fmt`` (a JDBC-style connector) the SQL is sent
    to the source as its ``query`` option; without, it runs on Spark's own
    tables and views."""
    if fmt is None:
        return spark.sql(sql)
    return spark.read.format(fmt).options(**options).option("query", sql).load()


def read_source_table(spark: SparkSession, table: str, fmt: str, **options) -> DataFrame:
    """S3: a whole table of a connector, named by its ``dbtable`` option."""
    return spark.read.format(fmt).options(**options).option("dbtable", table).load()

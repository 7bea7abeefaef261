"""Sinks: the monthly trips table (K1) and whole catalog tables (K2, K4).

Trips live in a ``monthly.MonthlyTable``: a load writes its own folder, and the catalog's months are
then pointed to it.  Rows are written by the tasks that hold them, without a shuffle: input files
are already one month each, so a task writes few partitions, and a month holding a third of all rows
is still spread over as many tasks as it has input splits.

Whole tables (dimensions, reports) are external catalog tables, read by name.  A new version is
written beside the old one, and the table's location is switched to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import TRIPS_ALL_COLUMNS, TRIPS_ALL_SCHEMA
from .monthly import MonthlyTable, quote


def write_trips(df: DataFrame, target: str, rebalance: bool = False) -> None:
    """K1: land canonical trips; only the months present in ``df`` are replaced, so doing it twice
    changes nothing.  ``rebalance`` is for input that is not already one month per task."""
    MonthlyTable(df.sparkSession, target).land(df, rebalance=rebalance)


overwrite_month = write_trips


def drop_month(spark: SparkSession, target: str, service: str, year: int, month: int) -> None:
    """Take one month out of the trips table, if it is there."""
    MonthlyTable(spark, target).empty([(service, year, month)])


def read_trips(spark: SparkSession, target: str) -> DataFrame:
    """The trips table with its declared schema; filters on service/year/month become partition
    filters.  A plain partitioned folder is read as well."""
    table = MonthlyTable(spark, target)
    if not table.has_ledger() and table.has_plain_months():
        return spark.read.schema(TRIPS_ALL_SCHEMA).parquet(target).select(*TRIPS_ALL_COLUMNS)
    return table.read()


def table_months(spark: SparkSession, target: str) -> DataFrame:
    """(service_type, year, month) present in a trips table, from the catalog."""
    return MonthlyTable(spark, target).months()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Replace a whole table at a path; the format is an argument so another
    connector can be named."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def _fresh(root: str) -> str:
    return f"{root.rstrip('/')}/version={uuid.uuid4().hex}"


def replace_table(df: DataFrame, name: str, root: str) -> DataFrame:
    """K2: replace the whole catalog table ``name`` and return it, read by name.

    ``df`` is written to a fresh folder under ``root``.  A table of the same columns is switched to
    it by one statement, so a reader sees the old or the new rows; one of other columns is
    registered anew.
    """
    spark, path = df.sparkSession, _fresh(root)
    df.write.parquet(path)
    if spark.catalog.tableExists(name):
        if [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in df.schema]:
            spark.sql(f"ALTER TABLE {name} SET LOCATION {quote(path)}")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION {quote(path)}")
    return spark.table(name)


def create_table_as(spark: SparkSession, name: str, query: str, root: str) -> DataFrame:
    """K4: ``CREATE TABLE name AS query``, replacing the table if there is one; read by name."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {quote(_fresh(root))} AS {query}")
    return spark.table(name)


def create_database(spark: SparkSession, name: str, root: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION {quote(root)}")
    return name

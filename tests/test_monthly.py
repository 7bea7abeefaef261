"""Monthly catalog tables: switch of months, ledger, footers."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import trips
from tripmart import session
from tripmart.schema import TRIPS_ALL_COLUMNS
from tripmart.sinks import monthly
from tripmart.sinks.monthly import MonthlyTable, Unit


def _rows(spark, n, month, service="yellow", fare=10.0):
    return trips(spark, [{"service_type": service, "month": month, "fare_amount": fare} for _ in range(n)])


def _counts(table):
    return {(r.service_type, r.year, r.month): r["count"] for r in table.read().groupBy(*monthly.KEYS).count().collect()}


@pytest.fixture
def table(spark):
    return MonthlyTable(spark, session.scratch_dir(spark, "t-monthly"))


def test_new_table_is_empty(table):
    assert table.read().columns == TRIPS_ALL_COLUMNS and table.read().count() == 0
    assert table.months().collect() == [] and table.counts().collect() == []


def test_land_replaces_only_its_months(spark, table):
    assert table.land(_rows(spark, 3, 1).union(_rows(spark, 2, 2))) == {("yellow", 2020, 1): 3, ("yellow", 2020, 2): 2}
    table.land(_rows(spark, 5, 1, fare=7.0))
    assert _counts(table) == {("yellow", 2020, 1): 5, ("yellow", 2020, 2): 2}
    assert table.read().where("month = 1").agg(F.max("fare_amount")).first()[0] == 7.0
    assert {tuple(r) for r in table.counts().collect()} == {("yellow", 2020, 1, 5), ("yellow", 2020, 2, 2)}
    assert len(table.vacuum()) == 0                 # month 2 still refers to the first load
    table.land(_rows(spark, 1, 2))
    assert len(table.vacuum()) == 1 and _counts(table) == {("yellow", 2020, 1): 5, ("yellow", 2020, 2): 1}


def test_failure_between_write_and_switch_keeps_the_old_month(spark, table, monkeypatch):
    table.land(_rows(spark, 3, 1))

    def fail(self, rows):
        raise OSError("lost")
    monkeypatch.setattr(MonthlyTable, "_commit", fail)
    with pytest.raises(OSError):
        table.land(_rows(spark, 9, 1))
    monkeypatch.undo()
    assert _counts(table) == {("yellow", 2020, 1): 3}
    assert len(table.vacuum()) == 1 and _counts(table) == {("yellow", 2020, 1): 3}


def test_failure_between_ledger_and_catalog_is_mended_by_the_next_open(spark, table, monkeypatch):
    table.land(_rows(spark, 3, 1))
    load = table.stage(_rows(spark, 4, 1))
    monkeypatch.setattr(MonthlyTable, "open", lambda self: self)
    table.switch(load)
    assert spark.table(table.name).count() == 3     # readers by name still see the old month, whole
    monkeypatch.undo()
    assert _counts(table) == {("yellow", 2020, 1): 4}


def test_two_writers_do_not_collide(spark, table):
    table.open()
    other = MonthlyTable(spark, table.root)
    a, b = table.stage(_rows(spark, 3, 1)), other.stage(_rows(spark, 2, 1).union(_rows(spark, 6, 2)))
    other.switch(b)
    table.switch(a)
    assert _counts(table) == _counts(other) == {("yellow", 2020, 1): 3, ("yellow", 2020, 2): 6}


def test_a_month_without_rows_is_emptied(spark, table):
    table.land(_rows(spark, 3, 1).union(_rows(spark, 2, 2)))
    got = table.land(_rows(spark, 4, 2), {("yellow", 2020, 1): Unit("u", "f"), ("yellow", 2020, 2): Unit("v", "g")})
    assert got == {("yellow", 2020, 1): 0, ("yellow", 2020, 2): 4}
    assert _counts(table) == {("yellow", 2020, 2): 4}
    table.empty([("yellow", 2020, 2)])
    assert table.read().count() == 0 and table.months().collect() == []


def test_another_catalog_is_restored_from_the_ledger(spark, table):
    table.land(_rows(spark, 3, 1).union(_rows(spark, 2, 2, "green")))
    again = MonthlyTable(spark, table.root, "restored_trips")
    assert _counts(again) == {("yellow", 2020, 1): 3, ("green", 2020, 2): 2}
    table.land(_rows(spark, 8, 1))                  # through the other name
    assert _counts(again) == {("yellow", 2020, 1): 8, ("green", 2020, 2): 2}
    spark.sql("DROP TABLE restored_trips")          # external: the files stay
    assert _counts(table) == {("yellow", 2020, 1): 8, ("green", 2020, 2): 2}


def test_month_filters_prune_in_the_catalog(spark, table):
    table.land(_rows(spark, 3, 1).union(_rows(spark, 2, 2)))
    df = table.read().where("year = 2020 AND month = 2")
    assert len(df.inputFiles()) < len(table.read().inputFiles())
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(year" in text and "month=2]" in text


def test_counts_come_from_footers(spark, table):
    table.land(_rows(spark, 3, 1))
    text = spark._jvm.PythonSQLUtils.explainString(table.counts()._jdf.queryExecution(), "formatted")
    assert "PushedAggregation: [COUNT(*)]" in text
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_odd_service_names(spark, table):
    odd = "o'd d/=%é"
    table.land(_rows(spark, 2, 1, odd))
    table.land(_rows(spark, 3, 1, odd))
    assert _counts(table) == {(odd, 2020, 1): 3}
    assert [tuple(r) for r in table.months().collect()] == [(odd, 2020, 1)]
    assert [tuple(r) for r in table.counts().collect()] == [(odd, 2020, 1, 3)]

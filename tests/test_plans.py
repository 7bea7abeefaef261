"""Plan shape: broadcast dims, pruned scans, one shuffle per aggregate."""

import pytest

from tripmart.plans.queries import QUERIES
from tests.conftest import SF_SMALL


def _plan(df):
    """The final adaptive plan (after execution), without the initial one."""
    df.collect()
    txt = df._jdf.queryExecution().executedPlan().toString()
    return txt.split("== Initial Plan ==")[0]


def test_enriched_reports_broadcast_small_dims(spark):
    p = _plan(QUERIES["tip_by_payment"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # only the payment join is planned: the zone joins are pruned (unique keys)
    assert p.count("BroadcastHashJoin") == 1


def _physical(df):
    """``explain("formatted")`` as text (untruncated filter lists)."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["trips_by_service_year", "row_counts"])
def test_counts_are_pushed_to_the_footers(spark, name):
    p = _physical(QUERIES[name](spark, SF_SMALL))
    assert "PushedAggregation: [COUNT(*)]" in p
    assert "pickup_datetime" not in p


def test_strict_rule_reaches_the_parquet_scan(spark):
    from tripmart.plans.mart import Mart
    from tripmart.operators import marts
    p = _physical(marts.strict(Mart(spark, SF_SMALL).trips_all))
    pushed = p[p.index("PushedFilters"):]
    for f in ("GreaterThan(fare_amount,0.0)", "GreaterThanOrEqual(trip_distance,0.1)",
              "LessThanOrEqual(trip_distance,100.0)"):
        assert f in pushed


def test_partition_filter_on_month(spark):
    from pyspark.sql import functions as F
    from tripmart.plans.mart import Mart
    p = _physical(Mart(spark, SF_SMALL).trips_all.where((F.col("year") == 1998) & (F.col("month") == 7)))
    assert "PartitionFilters: [isnotnull(year" in p and "(month" in p


def test_raw_union_prunes_columns(spark):
    from tripmart.plans.mart import Mart
    p = _physical(Mart(spark, SF_SMALL).trips_union.select("service_type", "trip_distance"))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in p
    assert "ReadSchema: struct<value:double>" in p
    assert "Exchange" not in p          # a union of scans, no shuffle


def test_full_enrichment_has_five_broadcast_joins(spark):
    p = _plan(QUERIES["obt_enriched"](spark, SF_SMALL))
    joins = [ln for ln in p.splitlines() if "BroadcastHashJoin" in ln and "LeftOuter" in ln]
    assert len(joins) == 5 and "SortMergeJoin" not in p
    # the dropoff role reuses the pickup role's zone broadcast
    assert "ReusedExchange" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_sort_merge_or_cross_join_in_any_query(spark, name):
    from tools.plan_report import final_plan, summarise
    s = summarise(final_plan(QUERIES[name](spark, SF_SMALL)))
    assert s["cross"] == 0 and s["smj"] == 0

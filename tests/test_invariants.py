"""Invariants of the view stack on the driver's smallest tables."""

import pytest
from pyspark.sql import functions as F

from tripmart.plans.mart import Mart
from tripmart.plans.queries import QUERIES
from tests.conftest import SF_SMALL

KEYS = ["service_type", "pickup_datetime", "dropoff_datetime", "fare_amount", "tip_amount",
        "trip_distance", "pu_location_id", "do_location_id"]


@pytest.fixture(scope="module")
def m(spark):
    return Mart(spark, SF_SMALL)


def test_obt_keeps_every_trip(m):
    assert m.obt.count() == m.trips_all.count() == m.trips_union.count()


def test_clean_and_strict_are_subsets_of_obt(m):
    assert m.clean.select(*KEYS).exceptAll(m.obt.select(*KEYS)).count() == 0
    assert m.strict.select(*KEYS).exceptAll(m.obt.select(*KEYS)).count() == 0
    assert 0 < m.clean.count() < m.obt.count()


def test_left_joins_never_change_row_count(m):
    assert m.enriched().count() == m.strict.count()
    assert m.enriched(("pu",)).count() == m.strict.count()


def test_at_most_ten_ranked_zones_per_month(spark):
    for q in ("top_pickup_zones", "top_dropoff_zones"):
        per = QUERIES[q](spark, SF_SMALL).groupBy("year", "month").count()
        assert per.agg(F.max("count")).first()[0] <= 10


def test_manifest_accounts_for_every_row(spark, m):
    man = QUERIES["load_manifest"](spark, SF_SMALL)
    assert man.agg(F.sum("rows_loaded")).first()[0] == m.trips_all.count()
    loaded = man.where("status = 'loaded'").count()
    assert loaded == m.trips_all.select("service_type", "year", "month").distinct().count()


def test_missing_plus_loaded_is_expected(spark, m):
    miss = QUERIES["missing_months"](spark, SF_SMALL).agg(F.sum("n_missing")).first()[0]
    loaded = m.trips_all.select("service_type", "year", "month").distinct().count()
    years = m.trips_all.agg(F.min("year"), F.max("year")).first()
    assert miss + loaded == 2 * 12 * (years[1] - years[0] + 1)

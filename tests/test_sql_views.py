"""Reports written as SQL text over the registered views equal the DataFrame reports."""

import pytest
from pyspark.sql import functions as F

from tripmart.operators import reports
from tripmart.plans import views
from tripmart.plans.mart import Mart
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def mart(spark):
    m = Mart(spark, SF_SMALL)
    views.register_views(spark, m.trips_all, m.dims)
    return m


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_pickup_zones_sql(spark, mart):
    sql = """
        SELECT year, month, pu_borough, pu_zone, trips FROM (
          SELECT year, month, pu_borough, pu_zone, COUNT(*) AS trips,
                 ROW_NUMBER() OVER (PARTITION BY year, month
                                    ORDER BY COUNT(*) DESC, pu_borough ASC NULLS LAST,
                                             pu_zone ASC NULLS LAST) AS rn
          FROM obt_trips_enriched
          GROUP BY 1, 2, 3, 4) t
        WHERE rn <= 10"""
    assert _rows(spark.sql(sql)) == _rows(reports.top_zones(mart.enriched(), "pu"))


def test_own_sql_over_the_enriched_view(spark, mart):
    """Statements of our own: longest trips by vendor, and boroughs with trips on both sides."""
    e = mart.enriched()
    by_vendor = spark.sql("SELECT vendor_name, MAX(trip_duration_min) FROM obt_trips_enriched GROUP BY vendor_name")
    assert _rows(by_vendor.na.fill("none")) == _rows(e.groupBy("vendor_name").agg(F.max("trip_duration_min")).na.fill("none"))
    both = spark.sql("""SELECT DISTINCT a.pu_borough AS b FROM obt_trips_enriched a
                        LEFT SEMI JOIN obt_trips_enriched z ON a.pu_borough = z.do_borough""")
    there, back = ({r[0] for r in e.select(c).distinct().collect()} - {None} for c in ("pu_borough", "do_borough"))
    assert {r["b"] for r in both.collect()} == there & back != set()


def test_dims_and_clean_view_sql(spark, mart):
    sizes = spark.sql("SELECT (SELECT COUNT(*) FROM payment_type_dim) AS p, (SELECT COUNT(*) FROM vendor_dim) AS v")
    assert tuple(sizes.first()) == (6, 2)
    left = spark.sql("SELECT COUNT(*) - (SELECT COUNT(*) FROM obt_trips_clean_v) AS dropped FROM obt_trips_v").first()["dropped"]
    assert left == mart.obt.count() - mart.clean.count() > 0

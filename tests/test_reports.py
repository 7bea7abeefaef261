"""Reports: ranking ties, NULL groups, coverage and code usage."""

from pyspark.sql import functions as F

from tripmart.operators import coverage, reports
from tests.helpers import trips, ts


def _enriched_rows(spark, counts):
    """One row per trip; counts = {(borough, zone): trips} in 2020-01."""
    data = []
    for (b, z), n in counts.items():
        data += [(2020, 1, b, z)] * n
    return spark.createDataFrame(data, "year int, month int, pu_borough string, pu_zone string")


def test_top_zones_ties_and_nulls(spark):
    counts = {("B", f"Z{i:02d}"): 20 - i for i in range(9)}     # 9 zones with 20..12 trips
    counts[("Q", "Tie-b")] = 5
    counts[("Q", "Tie-a")] = 5
    counts[("A", "Tie-z")] = 5
    counts[(None, None)] = 5
    out = reports.top_zones(_enriched_rows(spark, counts), "pu").collect()
    assert len(out) == 10
    assert (out[-1]["pu_borough"], out[-1]["pu_zone"]) == ("A", "Tie-z")


def test_top_zones_plan_limits_before_shuffle(spark):
    counts = {("B", f"Z{i:02d}"): i + 1 for i in range(30)}
    plan = reports.top_zones(_enriched_rows(spark, counts), "pu")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_corridor_having_and_limit(spark):
    rows = []
    for i in range(12):
        rows += [("B", f"P{i}", "B", f"D{i}", 0.01 * i)] * (3 if i != 5 else 1)
    df = spark.createDataFrame(rows, "pu_borough string, pu_zone string, do_borough string, "
                                     "do_zone string, tip_pct double")
    out = reports.top_corridors_tip(df, min_trips=2).collect()
    assert len(out) == 10 and all(r["n"] == 3 for r in out)
    assert out[0]["pu_zone"] == "P11"


def test_missing_months_example(spark):
    loaded = spark.createDataFrame([("yellow", 2015, 1), ("yellow", 2015, 3)],
                                   "service_type string, year int, month int")
    exp = coverage.expected_months(spark, (2015, 1), (2015, 4), services=("yellow",))
    miss = coverage.missing_months(exp, loaded).collect()
    assert [(r["year"], r["month"]) for r in miss] == [(2015, 2), (2015, 4)]
    by_year = coverage.missing_by_year(coverage.missing_months(exp, loaded)).first()
    assert by_year["missing_months"] == "02, 04" and by_year["n_missing"] == 2


def test_expected_months_cut_last_year(spark):
    exp = coverage.expected_months(spark, (2024, 11), (2025, 8), services=("green", "yellow"))
    assert exp.count() == 2 * 10
    assert exp.agg(F.max(coverage.month_index("year", "month"))).first()[0] == 2025 * 12 + 7


def test_stats_by_service_shape(spark):
    t = trips(spark, [dict(pickup_datetime=ts("2020-01-05 10:00:00"),
                           dropoff_datetime=ts("2020-01-05 10:05:00"))])
    from tripmart.operators import marts
    r = reports.stats_by_service(marts.clean(marts.obt(t))).collect()
    assert r[0].asDict() == {"service_type": "yellow", "avg_min": 5.0, "avg_dist": 2.0,
                             "avg_tip": 0.1, "n": 1}

"""The command line: load missing months, coverage, a report written out."""

import datetime as dt

from tripmart import session
from tripmart.__main__ import main
from tripmart.sources import files


def _raw_month(spark, root, y, m, n):
    rows = [(str(i % 3), dt.datetime(y, m, 1, 10, i), dt.datetime(y, m, 1, 10, i + 9),
             1.0 + i, 10.0, 1.0, 1.0) for i in range(n)]
    (spark.createDataFrame(rows, "vendor_id string, lpep_pickup_datetime timestamp_ntz, "
                                 "lpep_dropoff_datetime timestamp_ntz, trip_distance double, "
                                 "fare_amount double, tip_amount double, payment_type double")
     .write.parquet(files.month_path(root, "green", y, m)))


def test_cli_load_coverage_report(spark):
    raw = session.scratch_dir(spark, "t-cli-raw")
    table = session.scratch_dir(spark, "t-cli-trips")
    _raw_month(spark, raw, 2022, 1, 3)
    _raw_month(spark, raw, 2022, 3, 2)
    man = main(["load", "--raw", raw, "--table", table, "--start", "2022-01", "--end", "2022-03",
                "--services", "green"], spark)
    assert [(r["month"], r["status"]) for r in man.collect()] == \
        [(1, "loaded"), (2, "missing"), (3, "loaded")]
    cov = main(["coverage", "--table", table, "--start", "2022-01", "--end", "2022-03",
                "--services", "green"], spark).collect()
    assert [(r["year"], r["missing_months"]) for r in cov] == [(2022, "02")]
    out = session.scratch_dir(spark, "t-cli-out")
    main(["report", "stats_by_service", "--table", table, "--out", out], spark)
    r = spark.read.parquet(out).first()
    assert (r["service_type"], r["n"]) == ("green", 5)


def test_cli_enriched_report_with_zone_csv(spark):
    from pyspark.sql import functions as F
    from tests.conftest import SF_SMALL
    from tripmart.sources import testdata
    raw = session.scratch_dir(spark, "t-cli-raw2")
    table = session.scratch_dir(spark, "t-cli-trips2")
    _raw_month(spark, raw, 2023, 7, 6)
    main(["load", "--raw", raw, "--table", table, "--start", "2023-07", "--end", "2023-07",
          "--services", "green"], spark)
    zones = session.scratch_dir(spark, "t-cli-zones")
    testdata.zone_lookup(spark, SF_SMALL).write.option("header", True).csv(zones)
    out = main(["report", "top_pickup_zones", "--table", table, "--zones", zones], spark)
    rows = out.collect()
    assert sum(r["trips"] for r in rows) == 6 and len(rows) <= 10
    assert out.agg(F.max("month")).first()[0] == 7

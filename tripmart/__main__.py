"""Command line for cluster runs (``spark-submit`` or ``python -m tripmart``).

  load      load the months missing from the trips table, print the manifest
  coverage  months missing per service and year over a range
  report    run one report over the trips table; print it or write it

Paths are any Spark-readable paths.  Session settings come from the
cluster (spark-defaults / --conf); only the tripmart runtime defaults are set.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import session, sinks
from .operators import coverage, dims, ingest, marts, quality, reports


def _month(s: str) -> tuple[int, int]:
    y, m = s.split("-")
    return int(y), int(m)


def _zones_of(spark: SparkSession, zones_csv: str | None):
    """Dimensions; only reports that name zones need the lookup."""
    if zones_csv is not None:
        return dims.build_dims(spark, dims.read_zones_csv(spark, zones_csv))
    return dims.build_dims(spark, dims.clean_zones(spark.createDataFrame([], dims.ZONE_CSV_SCHEMA)))


#: Report -> the dimension roles it joins, and its function over the enriched trips.
ENRICHED = {
    "top_pickup_zones": (("pu",), lambda e: reports.top_zones(e, "pu")),
    "top_dropoff_zones": (("do",), lambda e: reports.top_zones(e, "do")),
    "revenue_by_borough_month": (("pu",), reports.revenue_by_borough_month),
    "speed_by_borough": (("pu",), reports.speed_by_borough),
    "tip_by_payment": (("payment",), reports.tip_by_payment),
    "top_corridors_tip": (("pu", "do"), reports.top_corridors_tip),
    "stats_by_hour": ((), reports.stats_by_hour),
}
CLEAN = {"stats_by_service": reports.stats_by_service, "stats_by_hour_service": reports.stats_by_hour_service,
         "stats_by_dow": reports.stats_by_dow}
REPORTS = ["trips_by_service_year", "quality_counts", "clean_pct", "row_counts", *CLEAN, *ENRICHED]


def _report(name: str, spark: SparkSession, table: str, zones_csv: str | None) -> DataFrame:
    trips = sinks.read_trips(spark, table)
    if name == "trips_by_service_year":
        return reports.trips_by_service_year(trips)
    if name == "row_counts":
        return quality.row_counts(trips, marts.obt(trips))
    if name == "quality_counts":
        return quality.quality_counts(marts.obt(trips))
    if name == "clean_pct":
        return quality.clean_pct(marts.obt(trips))
    if name in CLEAN:
        return CLEAN[name](marts.clean(marts.obt(trips)))
    roles, report = ENRICHED[name]
    if zones_csv is None and {"pu", "do"} & set(roles):
        raise SystemExit(f"report {name} needs --zones")
    return report(marts.enrich(marts.strict(trips), _zones_of(spark, zones_csv), roles))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    p = argparse.ArgumentParser(prog="tripmart")
    sub = p.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load")
    ld.add_argument("--raw", required=True)
    cov = sub.add_parser("coverage")
    for q in (ld, cov):
        q.add_argument("--table", required=True)
        q.add_argument("--start", required=True, type=_month, help="YYYY-MM")
        q.add_argument("--end", required=True, type=_month, help="YYYY-MM")
        q.add_argument("--services", default="yellow,green")
    rp = sub.add_parser("report")
    rp.add_argument("name", choices=REPORTS)
    rp.add_argument("--table", required=True)
    rp.add_argument("--zones")
    rp.add_argument("--out", help="write the report here (Parquet) instead of printing it")
    a = p.parse_args(argv)

    spark = session.configure(spark or SparkSession.builder.appName("tripmart").getOrCreate())
    if a.cmd == "load":
        out = ingest.load_missing(spark, a.raw, a.table, a.start, a.end,
                                  tuple(a.services.split(",")))
    elif a.cmd == "coverage":
        expected = coverage.expected_months(spark, a.start, a.end, tuple(a.services.split(",")))
        out = coverage.missing_by_year(
            coverage.missing_months(expected, sinks.table_months(spark, a.table)))
    else:
        out = _report(a.name, spark, a.table, a.zones)
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
            return out
    # every row, streamed: one partition at a time on the driver
    print(*out.columns, sep="\t")
    for row in out.toLocalIterator():
        print(*row, sep="\t")
    return out


if __name__ == "__main__":
    main(sys.argv[1:])

"""Benchmark: headline tripmart queries on the driver's tables.

Runs each query twice on local[$BENCH_CPUS] over $BENCH_SF_DIR (default
/root/testdata/sf0.1) and prints one JSON line with the best time per query
and their sum.  Reports are collected (they are small); full-table outputs
are written to the ``noop`` sink so only the computation is timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripmart.plans.queries import QUERIES  # noqa: E402
from tripmart.session import build_session  # noqa: E402

REPORTS = [
    "trips_by_service_year", "quality_counts", "clean_pct", "row_counts",
    "stats_by_service", "stats_by_hour_service", "stats_by_dow",
    "top_pickup_zones", "top_dropoff_zones", "revenue_by_borough_month",
    "speed_by_borough", "tip_by_payment", "top_corridors_tip", "stats_by_hour",
    "missing_months", "dim_codes",
]
FULL_OUTPUTS = ["obt_enriched", "trips_all"]
FILE_JOBS = ["load_manifest"]
ROLLUP = ["rollup_stats_by_hour_service", "rollup_top_pickup_zones", "rollup_revenue_by_borough_month",
          "rollup_top_corridors_tip", "rollup_stats_by_hour"]


def _run(spark, name, sf_dir):
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    if name in FULL_OUTPUTS:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="tripmart-bench-")
    extra = {"spark.driver.memory": "8g"}
    if os.environ.get("BENCH_EVENT_LOG") == "1":
        # stage/task times for later reading, in this run's own scratch folder
        os.makedirs(f"{scratch}/events")
        extra.update({"spark.eventLog.enabled": "true",
                      "spark.eventLog.dir": f"file://{scratch}/events"})
        print(f"event log: {scratch}/events", file=sys.stderr)
    spark = build_session(f"local[{cpus}]", app_name="tripmart-bench",
                          shuffle_partitions=max(8, 2 * cpus), extra=extra)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch)
    # JVM warm-up (class loading, JIT) on a raw scan, not timed
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    # The load job: harmonise the raw services into a monthly catalog table of this run's own
    # (timed); the tables that the reports read are kept by the mart, and made if they aren't there.
    from tripmart.plans.mart import Mart
    from tripmart.session import scratch_dir
    from tripmart.sinks.monthly import MonthlyTable
    mart = Mart(spark, sf_dir)
    t0 = time.perf_counter()
    MonthlyTable(spark, scratch_dir(spark, "bench-trips")).land(mart.trips_union, rebalance=True)
    times = {"load_trips": round(time.perf_counter() - t0, 3)}
    t0 = time.perf_counter()
    mart.table.open()
    mart.rollup
    times["keep_current"] = round(time.perf_counter() - t0, 3)
    # The raw services as monthly files (input of the file-based jobs).
    t0 = time.perf_counter()
    Mart(spark, sf_dir).raw_files_root
    times["write_raw_months"] = round(time.perf_counter() - t0, 3)
    _run(spark, "trips_by_service_year", sf_dir)      # warm-up (JIT, file footers)
    for name in REPORTS + ROLLUP + FULL_OUTPUTS + FILE_JOBS:
        times[name] = round(min(_run(spark, name, sf_dir) for _ in range(2)), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "tripmart_total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

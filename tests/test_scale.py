"""Scale behaviour on small data: a hot month, single-file month units."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tripmart import session, sinks
from tripmart.operators import reports
from tripmart.schema import TRIPS_ALL_COLUMNS
from tripmart.sources import files


def _skewed_trips(spark, n=120_000):
    """A third of all rows in one month (2020-01), the rest over 40 months."""
    ids = spark.range(n).withColumn("hot", F.col("id") % 3 == 0)
    month_idx = F.when(F.col("hot"), F.lit(0)).otherwise(F.col("id") % 40 + 1)
    return ids.select(
        F.lit("yellow").alias("service_type"),
        F.timestamp_add("SECOND", F.col("id") % 86400, F.lit("2020-01-01").cast("timestamp_ntz"))
         .alias("pickup_datetime"),
        F.timestamp_add("SECOND", F.col("id") % 86400 + 600, F.lit("2020-01-01").cast("timestamp_ntz"))
         .alias("dropoff_datetime"),
        F.lit(1).cast("long").alias("passenger_count"),
        (F.col("id") % 100 / 10).alias("trip_distance"),
        (F.col("id") % 7).alias("pu_location_id"),
        (F.col("id") % 11).alias("do_location_id"),
        F.lit(10.0).alias("fare_amount"), F.lit(1.0).alias("tip_amount"),
        F.lit(0.0).alias("tolls_amount"), F.lit(0.5).alias("mta_tax"),
        F.lit(0.3).alias("improvement_surcharge"), F.lit(None).cast("double").alias("congestion_surcharge"),
        F.lit(11.8).alias("total_amount"), F.lit("1").alias("payment_type"),
        F.lit("2").alias("vendor_id"), F.lit("1").alias("rate_code_id"),
        F.lit("N").alias("store_and_fwd_flag"),
        (F.lit(2020) + F.floor(month_idx / 12)).cast("int").alias("year"),
        (month_idx % 12 + 1).cast("int").alias("month"),
    ).select(*TRIPS_ALL_COLUMNS)


def test_hot_month_is_split_across_tasks_on_write(spark):
    df = _skewed_trips(spark).repartition(8)          # not month-aligned input
    target = session.scratch_dir(spark, "t-skew")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sinks.write_trips(df, target, rebalance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    root = session.local_path(target)
    hot = glob.glob(f"{root}/loads/load=*/service_type=yellow/year=2020/month=1/*.parquet")
    assert len(hot) > 1, "the hot month went to a single task"
    back = sinks.read_trips(spark, target)
    per_file = (back.where("year = 2020 AND month = 1")
                .groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
    assert per_file < 40_000 // 2, "one task wrote most of the hot month"
    assert back.count() == 120_000
    assert back.where("year = 2020 AND month = 1").count() == 40_000


def test_hot_key_report_is_exact(spark):
    """Partial aggregation: the hot month's count is exact, nothing dropped."""
    out = {(r["service_type"], r["year"]): r["total_viajes"]
           for r in reports.trips_by_service_year(_skewed_trips(spark)).collect()}
    assert sum(out.values()) == 120_000 and out[("yellow", 2020)] > 40_000


def test_single_file_month_units(spark):
    """The source publishes one Parquet file per month; both layouts are units."""
    root = session.local_path(session.scratch_dir(spark, "t-files"))
    os.makedirs(root)
    t = pa.table({"VendorID": [1, 2], "tpep_pickup_datetime": pa.array([0, 60_000_000], pa.timestamp("us")),
                  "tpep_dropoff_datetime": pa.array([600_000_000, 700_000_000], pa.timestamp("us")),
                  "fare_amount": [10.0, 12.0]})
    pq.write_table(t, f"{root}/yellow_tripdata_2019-01.parquet")
    pq.write_table(t, f"{root}/Yellow_Tripdata_2019-02.parquet")
    inv = files.inventory_files(files.list_units(spark, root)).collect()
    assert [(r["service_type"], r["year"], r["month"], r["n_files"]) for r in inv] == \
        [("yellow", 2019, 1, 1), ("yellow", 2019, 2, 1)]
    m = files.load_month(spark, root, "yellow", 2019, 1)
    assert m.count() == 2


CONCURRENT = "spark.sql.maxConcurrentOutputFileWriters"


def _insert_plan(spark, df):
    """Plan of a partitioned write in this session."""
    df.createOrReplaceTempView("side_by_side_rows")
    spark.sql("CREATE TABLE IF NOT EXISTS side_by_side (id LONG, m INT) USING parquet PARTITIONED BY (m) "
              f"LOCATION '{session.scratch_dir(spark, 't-side')}'")
    return spark.sql("EXPLAIN INSERT INTO side_by_side SELECT id, m FROM side_by_side_rows").first()[0]


def test_months_are_written_without_a_sort_of_all_rows(spark):
    rows = spark.range(100).withColumn("m", (F.col("id") % 5).cast("int"))
    writes = (lambda: sinks.write_trips(_skewed_trips(spark, 400), session.scratch_dir(spark, "t-unsorted")),
              lambda: files.write_months(rows.withColumn("y", F.lit(2020)).withColumn("m", F.col("m") + 1),
                                         session.scratch_dir(spark, "t-unsorted"), "green", "y", "m"))
    for write in writes:
        spark.conf.unset(CONCURRENT)
        assert "Sort [" in _insert_plan(spark, rows)
        write()
        assert "Sort [" not in _insert_plan(spark, rows)
    spark.sql("DROP TABLE side_by_side")


def test_more_months_than_open_files_lose_no_row(spark):
    spark.conf.set(CONCURRENT, "3")
    try:
        df, target = _skewed_trips(spark, 3_000).coalesce(1), session.scratch_dir(spark, "t-many")
        sinks.write_trips(df, target)
        assert spark.conf.get(CONCURRENT) == "3"            # the caller's setting stays
        assert sorted(map(tuple, sinks.read_trips(spark, target).groupBy("year", "month").count().collect())) \
            == sorted(map(tuple, df.groupBy("year", "month").count().collect()))
    finally:
        spark.conf.unset(CONCURRENT)

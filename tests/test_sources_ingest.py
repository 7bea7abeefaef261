"""Files, harmonisation, load manifest, month overwrite, catalog inventory."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tripmart import session, sinks
from tripmart.operators import coverage, harmonize, ingest
from tripmart.sources import catalog, files


def _green_month(spark, n=5, with_congestion=False, vendor_col="vendor_id"):
    rows = [(str(i % 3), dt.datetime(2019, 1, 1, 10, i), dt.datetime(2019, 1, 1, 10, i + 7),
             1.5 * i, 10.0 + i, 1.0, 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, f"{vendor_col} string, lpep_pickup_datetime timestamp, "
                                     "lpep_dropoff_datetime timestamp, trip_distance double, "
                                     "fare_amount double, tip_amount double, payment_type double")
    if with_congestion:
        df = df.withColumn("congestion_surcharge", F.lit(2.75))
    return df


def test_harmonize_missing_and_alternate_columns(spark):
    h = harmonize.harmonize(_green_month(spark, vendor_col="VENDORID"), "green", 2019, "01")
    r = h.first()
    assert h.schema["congestion_surcharge"].dataType.simpleString() == "double"
    assert r["congestion_surcharge"] is None and r["passenger_count"] is None
    assert r["vendor_id"] == "0" and r["payment_type"] == "2"
    assert (r["service_type"], r["year"], r["month"]) == ("green", 2019, 1)
    assert h.schema["pickup_datetime"].dataType.simpleString() == "timestamp_ntz"


def test_pick_coalesce_never_names_missing_columns(spark):
    a = _green_month(spark, 2, vendor_col="VendorID")
    b = _green_month(spark, 2, vendor_col="vendor_id").withColumn("vendor_id", F.lit("7"))
    merged = a.unionByName(b, allowMissingColumns=True)
    out = harmonize.harmonize(merged, "green", 2019, 1, mode="coalesce")
    assert sorted(r["vendor_id"] for r in out.collect()) == ["0", "1", "7", "7"]


def _write_raw(spark, root, months):
    for (svc, y, m), df in months.items():
        df.write.mode("overwrite").parquet(files.month_path(root, svc, y, m))


def test_load_month_and_inventory(spark):
    root = session.scratch_dir(spark, "t-raw")
    _write_raw(spark, root, {("green", 2019, 1): _green_month(spark),
                             ("green", 2019, 3): _green_month(spark, with_congestion=True)})
    # a copy of a month in a sub-folder and a file with a foreign name
    _green_month(spark).write.parquet(f"{root}/old/green_tripdata_2019-01.parquet")
    _green_month(spark).write.parquet(f"{root}/notes_2019.parquet")
    assert files.load_month(spark, root, "green", 2019, "02") is None
    m = files.load_month(spark, root, "green", 2019, "01", sample=2)
    assert m.count() == 2
    assert m.schema["lpep_pickup_datetime"].dataType.simpleString() == "timestamp_ntz"
    inv = {(r["year"], r["month"]): r["n_files"]
           for r in files.inventory_files(files.list_units(spark, root)).collect()}
    assert inv == {(2019, 1): 2, (2019, 3): 1}


def test_ingest_manifest_isolates_bad_month_and_reload_is_idempotent(spark):
    root = session.scratch_dir(spark, "t-raw2")
    _write_raw(spark, root, {("green", 2019, 1): _green_month(spark, 5),
                             ("green", 2019, 2): _green_month(spark, 4, with_congestion=True)})
    bad = files.month_path(root, "green", 2019, 3)
    os.makedirs(session.local_path(bad))
    with open(os.path.join(session.local_path(bad), "part-0.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    plan = coverage.expected_months(spark, (2019, 1), (2019, 4), services=("green",))
    target = session.scratch_dir(spark, "t-trips")
    man = {(r["month"]): (r["rows_loaded"], r["status"])
           for r in ingest.run(spark, plan, root, target).collect()}
    assert man[1] == (5, "loaded") and man[2] == (4, "loaded")
    assert man[3][1] == "error" and man[4] == (0, "missing")
    before = sinks.read_trips(spark, target).count()
    # re-loading a month already in the table replaces it: row count unchanged
    jan = coverage.expected_months(spark, (2019, 1), (2019, 1), services=("green",))
    ingest.run(spark, jan, root, target).collect()
    ingest.run(spark, jan, root, target).collect()
    assert sinks.read_trips(spark, target).count() == before == 9
    # partition filters reach the scan
    plan_txt = sinks.read_trips(spark, target).where("year = 2019 AND month = 2") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan_txt and "month" in plan_txt


def test_catalog_inventory_rejects_samples(spark):
    df = spark.range(1)
    for n in ["TRIPS_GREEN_2019_01", "TRIPS_GREEN_2019_01_TINY", "TRIPS_ALL", "trips_yellow_2020_12"]:
        df.createOrReplaceTempView(n)
    out = [(r["service_type"], r["yr"], r["mo"]) for r in catalog.inventory_months(spark).collect()]
    assert out == [("green", 2019, 1), ("yellow", 2020, 12)]


def test_missing_only_plan_drives_the_next_load(spark):
    """L3/Q16: coverage of the loaded table decides what the next run loads."""
    root = session.scratch_dir(spark, "t-raw3")
    target = session.scratch_dir(spark, "t-trips3")
    _write_raw(spark, root, {("green", 2020, 1): _green_month(spark, 3),
                             ("green", 2020, 2): _green_month(spark, 2)})
    expected = coverage.expected_months(spark, (2020, 1), (2020, 3), services=("green",))
    first = ingest.run(spark, expected, root, target)
    assert [r["status"] for r in first.collect()] == ["loaded", "loaded", "missing"]
    # the March file arrives; only the missing month is planned and loaded
    _write_raw(spark, root, {("green", 2020, 3): _green_month(spark, 4)})
    loaded = coverage.loaded_months(sinks.read_trips(spark, target))
    plan = coverage.load_plan(expected, loaded)
    assert [(r["year"], r["month"]) for r in plan.collect()] == [(2020, 3)]
    second = ingest.run(spark, plan, root, target).collect()
    assert [(r["month"], r["rows_loaded"], r["status"]) for r in second] == [(3, 4, "loaded")]
    counts = {r["month"]: r["count"] for r in
              sinks.read_trips(spark, target).groupBy("month").count().collect()}
    assert counts == {1: 3, 2: 2, 3: 4}


def test_load_missing_end_to_end(spark):
    """Empty target: everything expected is planned; second call: nothing left."""
    root = session.scratch_dir(spark, "t-raw4")
    target = session.scratch_dir(spark, "t-trips4")
    _write_raw(spark, root, {("green", 2021, 5): _green_month(spark, 2),
                             ("green", 2021, 6): _green_month(spark, 3)})
    first = ingest.load_missing(spark, root, target, (2021, 5), (2021, 6), services=("green",))
    assert [(r["month"], r["rows_loaded"], r["status"]) for r in first.collect()] == \
        [(5, 2, "loaded"), (6, 3, "loaded")]
    again = ingest.load_missing(spark, root, target, (2021, 5), (2021, 6), services=("green",))
    assert again.count() == 0
    from tripmart.plans.mart import Mart
    m = Mart(spark, "/root/testdata/sf0.001", trips_table=target)
    assert m.trips_all.count() == 5 and m.obt.count() == 5


def test_landing_a_month_twice_replaces_it(spark):
    root = session.scratch_dir(spark, "t-land")
    df = _green_month(spark, 4).select("*", F.lit(2019).alias("y"), F.lit(1).alias("m"))
    files.write_months(df, root, "green", "y", "m")
    files.write_months(df, root, "green", "y", "m")
    assert files.load_month(spark, root, "green", 2019, 1).count() == 4
    inv = files.inventory_files(files.list_units(spark, root)).collect()
    assert [(r["month"], r["n_files"]) for r in inv] == [(1, 1)]


def test_table_months_from_the_catalog(spark):
    target = session.scratch_dir(spark, "t-months")
    t = _green_month(spark, 2)
    h = (harmonize.harmonize(t, "green", 2019, 1)
         .unionByName(harmonize.harmonize(t, "green", 2019, 11))
         .unionByName(harmonize.harmonize(t, "yellow", 2020, 3)))
    sinks.write_trips(h, target)
    got = sorted(tuple(r) for r in sinks.table_months(spark, target).collect())
    want = sorted(tuple(r) for r in coverage.loaded_months(sinks.read_trips(spark, target)).collect())
    assert got == want == [("green", 2019, 1), ("green", 2019, 11), ("yellow", 2020, 3)]


def test_month_published_twice_is_an_error_naming_both(spark):
    """Choosing one of two differing units would lose the rows of the other."""
    root = session.scratch_dir(spark, "t-dup")
    _write_raw(spark, root, {("green", 2018, 6): _green_month(spark, 4)})
    _green_month(spark, 7).write.parquet(f"{root}/old/green_tripdata_2018-06.parquet")
    inv = files.inventory_files(files.list_units(spark, root)).first()
    assert inv["n_files"] == 2
    plan = coverage.expected_months(spark, (2018, 6), (2018, 6), services=("green",))
    man = ingest.run(spark, plan, root, session.scratch_dir(spark, "t-dup-trips")).first()
    assert (man["rows_loaded"], man["status"]) == (0, "error")
    assert man["error"].startswith("duplicate: ") and man["error"].count("green_tripdata_2018-06") == 2


def test_emptied_month_loses_its_old_rows(spark):
    root, target = session.scratch_dir(spark, "t-empty"), session.scratch_dir(spark, "t-empty-trips")
    _write_raw(spark, root, {("green", 2018, 6): _green_month(spark, 5), ("green", 2018, 7): _green_month(spark, 2)})
    plan = coverage.expected_months(spark, (2018, 6), (2018, 7), services=("green",))
    assert [r["rows_loaded"] for r in ingest.run(spark, plan, root, target).collect()] == [5, 2]
    emptied = session.scratch_dir(spark, "t-emptied")
    _write_raw(spark, emptied, {("green", 2018, 6): _green_month(spark, 5).limit(0)})
    # the plan comes from the table that the load rewrites
    plan = sinks.table_months(spark, target).where("month = 6")
    man = ingest.run(spark, plan, emptied, target).first()
    assert (man["rows_loaded"], man["status"]) == (0, "loaded")
    assert sinks.read_trips(spark, target).groupBy("month").count().collect() == [(7, 2)]


def test_zoned_times_load_as_utc_under_any_session_zone(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tripmart.functions import casts
    df = spark.range(1).select(F.timestamp_micros(F.lit(1541309400_000001)).alias("t"))     # 05:30 UTC, a repeated hour
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(casts.to_timestamp_ntz(F.col("t"), T.TimestampType()).cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2018-11-04 05:30:00.000001"


def test_sample_zero_means_no_rows(spark):
    """Q11: ``sample`` is honoured literally (None = whole month, 0 = no rows)."""
    root = session.scratch_dir(spark, "t-sample")
    _write_raw(spark, root, {("green", 2017, 4): _green_month(spark, 5)})
    assert files.load_month(spark, root, "green", 2017, 4, sample=0).count() == 0
    assert files.load_month(spark, root, "green", 2017, 4, sample=3).count() == 3
    assert files.load_month(spark, root, "green", 2017, 4).count() == 5


def test_a_month_of_drifting_parts_keeps_every_value(spark, tmp_path):
    root = tmp_path / "raw"
    unit = f"{root}/green/2019/green_tripdata_2019-01.parquet"
    for order in (False, True):
        _green_month(spark, 4, with_congestion=order).coalesce(1).write.mode("append").parquet(unit)
    plan = spark.createDataFrame([("green", 2019, 1)], "service_type string, year int, month int")
    target = str(tmp_path / "trips")
    row = ingest.run(spark, plan, str(root), target).first()
    assert (row["rows_loaded"], row["status"]) == (8, "loaded")
    got = [r["congestion_surcharge"] for r in sinks.read_trips(spark, target).collect()]
    assert got.count(2.75) == 4 and got.count(None) == 4


def test_a_month_whose_parts_dont_merge_is_read_file_by_file(spark, tmp_path):
    root = tmp_path / "raw"
    unit = f"{root}/green/2019/green_tripdata_2019-01.parquet"
    month = _green_month(spark, 4)
    month.write.mode("append").parquet(unit)
    month.withColumn("fare_amount", F.when(F.col("vendor_id") == "1", F.lit("free")).otherwise(F.lit("3.5"))) \
        .write.mode("append").parquet(unit)
    plan = spark.createDataFrame([("green", 2019, 1)], "service_type string, year int, month int")
    target = str(tmp_path / "trips")
    row = ingest.run(spark, plan, str(root), target).first()
    assert (row["rows_loaded"], row["status"]) == (8, "loaded")
    fares = sorted((r["fare_amount"] for r in sinks.read_trips(spark, target).collect()), key=str)
    assert fares == [10.0, 11.0, 12.0, 13.0, 3.5, 3.5, 3.5, None]


def test_one_bad_month_among_many_costs_few_jobs(spark, tmp_path, monkeypatch):
    from tripmart.sinks.monthly import MonthlyTable
    months = [{"unit": f"u{i}", "service_type": "green", "year": 2010 + i // 12, "month": i % 12 + 1, "fingerprint": "f"}
              for i in range(64)]
    staged = []

    def stage(self, batch, rebalance=False):
        staged.append(batch)
        if ("u37", "green") in batch:
            raise OSError("u37 is bad")
        return ",".join(u for u, _ in batch)

    monkeypatch.setattr(ingest.files, "read_units", lambda spark, units, scans, watched: units)
    monkeypatch.setattr(MonthlyTable, "stage", stage)
    monkeypatch.setattr(MonthlyTable, "switch", lambda self, load, units: {m: 1 for m in units})
    rows, errors = ingest._land(spark, MonthlyTable(spark, str(tmp_path)), months, {m["unit"]: [] for m in months})
    assert len(staged) == 13 and len(rows) == 63
    assert errors == [("green", 2013, 2, "OSError: u37 is bad")]


def test_only_new_and_changed_units_are_opened(spark, monkeypatch):
    root, target = session.scratch_dir(spark, "t-current"), session.scratch_dir(spark, "t-current-trips")
    _write_raw(spark, root, {("green", 2020, m): _green_month(spark, m) for m in (1, 2, 3)})
    assert [tuple(r)[2:5] for r in ingest.load_current(spark, root, target).collect()] == \
        [(1, 1, "loaded"), (2, 2, "loaded"), (3, 3, "loaded")]
    assert ingest.load_current(spark, root, target).collect() == []
    opened = []
    scans = files.unit_scans
    monkeypatch.setattr(files, "unit_scans", lambda spark, units, **k: opened.extend(units) or scans(spark, units, **k))
    _write_raw(spark, root, {("green", 2020, 2): _green_month(spark, 5), ("green", 2020, 4): _green_month(spark, 1)})
    assert [tuple(r)[2:5] for r in ingest.load_current(spark, root, target).collect()] == [(2, 5, "loaded"), (4, 1, "loaded")]
    assert sorted(u[-15:] for u in opened) == ["2020-02.parquet", "2020-04.parquet"]
    counts = {r["month"]: r["count"] for r in sinks.read_trips(spark, target).groupBy("month").count().collect()}
    assert counts == {1: 1, 2: 5, 3: 3, 4: 1}
    # a month that fails isn't in the ledger, and is tried again
    os.remove(next(os.path.join(d, f) for d, _, fs in os.walk(session.local_path(files.month_path(root, "green", 2020, 3)))
                   for f in fs if f.endswith(".parquet")))
    with open(os.path.join(session.local_path(files.month_path(root, "green", 2020, 3)), "bad.parquet"), "wb") as f:
        f.write(b"no")
    for _ in range(2):
        assert [tuple(r)[2:5] for r in ingest.load_current(spark, root, target).collect()] == [(3, 0, "error")]
    assert sinks.read_trips(spark, target).where("month = 3").count() == 3


def test_sample_does_not_depend_on_the_layout(spark):
    root = session.scratch_dir(spark, "t-layout")
    rows = _green_month(spark, 40)
    _write_raw(spark, root, {("green", 2017, 4): rows.coalesce(1), ("green", 2017, 5): rows.repartition(7)})
    a, b = (sorted(map(str, files.load_month(spark, root, "green", 2017, m, sample=9).collect())) for m in (4, 5))
    assert a == b and len(a) == 9


def test_raw_months_and_samples_in_the_catalog(spark):
    from tests.conftest import SF_SMALL
    from tripmart.plans.mart import Mart
    m = Mart(spark, SF_SMALL)
    names = {r["table_name"] for r in catalog.catalog_tables(spark, m.raw_database).collect()}
    assert {"trips_all", "trips_yellow_1998_07"} < names and any(n.endswith("_tiny") for n in names)
    parsed = {r["table_name"] for r in catalog.inventory_months(spark, m.raw_database).collect()}
    assert parsed == {n for n in names if not n.endswith("_tiny") and n != "trips_all"}
    month = spark.table(f"{m.raw_database}.trips_yellow_1998_07")
    assert month.count() == files.load_month(spark, m.raw_files_root, "yellow", 1998, 7).count()


def test_trips_table_is_current_without_a_rewrite_in_another_application(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from tripmart.plans import mart
    from tripmart.sinks import monthly
    n = mart.Mart(spark, SF_SMALL).trips_all.count()
    # as another application with another catalog: nothing in memory, no table
    monkeypatch.setattr(mart, "_CURRENT", {})
    monkeypatch.setattr(monthly, "_APPLIED", {})
    spark.sql(f"DROP TABLE {mart.Mart(spark, SF_SMALL).table.name}")
    monkeypatch.setattr(mart, "_CURRENT", {})
    landed = []
    stage = monthly.MonthlyTable.stage
    monkeypatch.setattr(monthly.MonthlyTable, "stage", lambda self, *a, **k: landed.append(self.name) or stage(self, *a, **k))
    assert mart.Mart(spark, SF_SMALL).trips_all.count() == n and landed == []
    # a source that changed is landed again, the other service isn't
    monkeypatch.setattr(mart, "_CURRENT", {})
    stamp = mart._stamp
    monkeypatch.setattr(mart, "_stamp", lambda spark, p: "changed" if "events" in p else stamp(spark, p))
    m = mart.Mart(spark, SF_SMALL)
    assert m.trips_all.count() == n and len(landed) == 1
    loads = {r["service_type"]: r["load"] for r in m.table.current().select("service_type", "load").distinct().collect()}
    assert len(set(loads.values())) == 2


def test_query_and_dbtable_reach_an_in_process_source(spark):
    """S3: a Python data source stands for a connector; its options and filters are recorded by its rows."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options, self.day = options, None

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("day",):
                    self.day = f.value
                else:
                    yield f

        def partitions(self):
            return [InputPartition(d) for d in ("mon", "tue") if self.day in (None, d)]

        def read(self, partition):
            yield self.options.get("query") or self.options["dbtable"], partition.value, len(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "in_process"

        def schema(self):
            return "asked string, day string, n int"

        def reader(self, schema):
            return Reader(self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    got = catalog.read_query(spark, "SELECT 1", fmt="in_process", url="x")
    assert sorted(tuple(r) for r in got.collect()) == [("SELECT 1", "mon", 3), ("SELECT 1", "tue", 3)]
    one = got.where("day = 'tue'")
    assert one.rdd.getNumPartitions() == 1 and [r["day"] for r in one.collect()] == ["tue"]
    table = catalog.read_source_table(spark, "TRIPS_GREEN_2019_01", "in_process", url="x").where("n > 2")
    assert {r["asked"] for r in table.collect()} == {"TRIPS_GREEN_2019_01"}


def test_replace_table_switches_to_the_new_version(spark):
    root = session.scratch_dir(spark, "t-table")
    assert sinks.replace_table(spark.range(3), "t_replace", root).count() == 3
    old = spark.table("t_replace").inputFiles()
    assert sinks.replace_table(spark.range(5), "t_replace", root).count() == 5
    assert spark.table("t_replace").count() == 5 and not set(old) & set(spark.table("t_replace").inputFiles())
    assert spark.read.parquet(*old).count() == 3    # the old version was not touched
    assert sinks.replace_table(spark.range(2).selectExpr("id AS k", "'x' AS v"), "t_replace", root).columns == ["k", "v"]
    assert sinks.create_table_as(spark, "t_replace", "SELECT 7 AS x", root).first()[0] == 7

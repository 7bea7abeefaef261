"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory; each reads the driver's tables through the
adapter and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import session, sinks
from ..functions import casts
from ..operators import coverage, dims, harmonize, ingest, quality, reports, rollup
from ..schema import TRIPS_ALL_COLUMNS
from ..sinks.monthly import MonthlyTable, Unit
from ..sources import catalog, files, testdata
from . import views
from .mart import Mart

Query = Callable[[SparkSession, str], DataFrame]
#: The load plan of ``load_missing`` ends with this month of the last year.
LAST_MONTH = 8


def _m(spark, sf_dir) -> Mart:
    return Mart(spark, sf_dir)


def q_trips_all(spark, sf_dir):
    """The harmonised branches unioned by name (the lazy plan)."""
    return _m(spark, sf_dir).trips_union


def q_obt(spark, sf_dir):
    """The One-Big-Table over every trip (24 columns)."""
    return _m(spark, sf_dir).obt


def q_obt_clean(spark, sf_dir):
    """The OBT filtered by the clean rule set."""
    return _m(spark, sf_dir).clean


def q_obt_strict(spark, sf_dir):
    """The OBT with trip_duration_min, filtered by the strict rule set."""
    return _m(spark, sf_dir).strict


def q_obt_enriched(spark, sf_dir):
    """Strict trips with zones (two roles) and code descriptions."""
    return _m(spark, sf_dir).enriched()


def q_trips_by_service_year(spark, sf_dir):
    """Trips per service and year."""
    return reports.trips_by_service_year_of(_m(spark, sf_dir).table.counts())


def q_quality_counts(spark, sf_dir):
    """R2/A2: negative durations, negative and above-500 % tip shares."""
    return quality.quality_counts(_m(spark, sf_dir).obt)


def q_clean_pct(spark, sf_dir):
    """Rows kept by the clean rule and their share of all rows."""
    return quality.clean_pct(_m(spark, sf_dir).obt)


def q_row_counts(spark, sf_dir):
    """L4: rows of the raw tables against rows of the loaded table, which the OBT has one row for
    each of; a load that lost or duplicated rows shows as a mismatch.  Only footers are read."""
    return quality.reconcile(testdata.source_rows(spark, sf_dir), _m(spark, sf_dir).table.counts())


def q_stats_by_service(spark, sf_dir):
    """Clean-trip profile per service."""
    return reports.stats_by_service(_m(spark, sf_dir).clean)


def q_stats_by_hour_service(spark, sf_dir):
    """Clean-trip profile per pickup hour and service."""
    return reports.stats_by_hour_service(_m(spark, sf_dir).clean)


def q_stats_by_dow(spark, sf_dir):
    """Clean-trip profile per weekday, weekend flag and service."""
    return reports.stats_by_dow(_m(spark, sf_dir).clean)


def q_top_pickup_zones(spark, sf_dir):
    """Ten pickup zones with most trips per month."""
    return reports.top_zones(_m(spark, sf_dir).enriched(("pu",)), "pu")


def q_top_dropoff_zones(spark, sf_dir):
    """Ten dropoff zones with most trips per month."""
    return reports.top_zones(_m(spark, sf_dir).enriched(("do",)), "do")


def q_revenue_by_borough_month(spark, sf_dir):
    """Revenue, tip share and trips per month and pickup borough."""
    return reports.revenue_by_borough_month(_m(spark, sf_dir).enriched(("pu",)))


def q_speed_by_borough(spark, sf_dir):
    """Average, min and max speed per pickup borough."""
    return reports.speed_by_borough(_m(spark, sf_dir).enriched(("pu",)))


def q_tip_by_payment(spark, sf_dir):
    """Average tip share per payment description."""
    return reports.tip_by_payment(_m(spark, sf_dir).enriched(("payment",)))


def q_top_corridors_tip(spark, sf_dir):
    """Ten zone pairs with the highest tip share (more than 500 trips)."""
    return reports.top_corridors_tip(_m(spark, sf_dir).enriched(("pu", "do")))


def q_stats_by_hour(spark, sf_dir):
    """Strict-trip profile per pickup hour."""
    return reports.stats_by_hour(_m(spark, sf_dir).enriched(()))




# ---- projections and scalar functions -------------------------------------

def q_normalize_ts(spark, sf_dir):
    """The raw rows of both services, pickup/dropoff made plain timestamps."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [harmonize.normalize_timestamps(r.raw()) for r in _m(spark, sf_dir).raw_services])


def q_harmonize(spark, sf_dir):
    """Both branches (alternate names, missing surcharges) harmonised."""
    m = _m(spark, sf_dir)
    return m.harmonized("yellow").unionByName(m.harmonized("green"))


def q_pick_coalesce(spark, sf_dir):
    """Both services in one by-name union (alternates side by side), then
    the COALESCE form of the pick over the candidates that exist."""
    m = _m(spark, sf_dir)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [r.df.withColumn("_service", F.lit(r.service)) for r in m.raw_services])
    return harmonize.harmonize(merged, F.col("_service"), testdata.FILE_YEAR,
                               testdata.FILE_MONTH, mode="coalesce")


def q_scalars_time(spark, sf_dir):
    """F1-F6 on every trip."""
    t = _m(spark, sf_dir).trips_all
    p, d = "pickup_datetime", "dropoff_datetime"
    return t.select(
        "service_type", p, d,
        fn.minutes_between(p, d).alias("trip_minutes"),
        fn.seconds_between(p, d).alias("trip_seconds"),
        F.timestamp_diff("MINUTE", F.col(p), F.col(d)).alias("elapsed_minutes"),
        fn.hour_of(p).alias("pickup_hour"),
        fn.day_name(p).alias("pickup_dow"),
        fn.is_weekend(p).alias("is_weekend"),
        fn.date_of(p).alias("pickup_date"),
    )


def q_scalars_ratio(spark, sf_dir):
    """F7, F8, F12, F17 on every trip (F13 ROUND is exercised by every report:
    per-row rounding of arbitrary doubles differs between engines at
    non-representable halves such as 1.005)."""
    t = _m(spark, sf_dir).trips_all
    secs = fn.seconds_between("pickup_datetime", "dropoff_datetime")
    return t.select(
        "service_type", "fare_amount", "tip_amount", "trip_distance",
        fn.tip_pct().alias("tip_pct"),
        fn.speed_mph("trip_distance", secs).alias("avg_speed_mph"),
        fn.iff(F.nullifzero("fare_amount").isNull(), F.lit(True), F.lit(False))
          .alias("fare_is_zero"),
        (F.col("total_amount") - F.col("fare_amount") - F.col("tip_amount"))
          .alias("other_charges"),
    )


def q_scalars_name(spark, sf_dir):
    """Month names built from the data and parsed back.

    The ``_TINY`` sample name shows why parsing is anchored: split positions
    accept it, the anchored pattern does not."""
    months = loaded_months(spark, sf_dir)
    tname = fn.table_name("service_type", "year", "month")
    tiny = F.concat(tname, F.lit("_TINY"))
    return months.select(
        "service_type", "year", "month",
        tname.alias("table_name"),
        fn.file_name("service_type", "year", "month").alias("file_name"),
        fn.extract_int(tname, fn.TABLE_PATTERN, 2).alias("re_year"),
        fn.extract_int(tname, fn.TABLE_PATTERN, 3).alias("re_month"),
        fn.extract_int(tiny, fn.TABLE_PATTERN, 2).alias("tiny_re_year"),
        fn.split_part_int(tiny, "_", 3).alias("tiny_split_year"),
        fn.split_part_int(tiny, "_", 4).alias("tiny_split_month"),
        F.lower(F.trim(F.concat(F.lit("  "), tname, F.lit(" ")))).alias("table_lower"),
        fn.month2("month").alias("month2"),
    )


def q_scalars_cast(spark, sf_dir):
    """warehouse casts on raw values of both services."""
    m = _m(spark, sf_dir)
    y = m.raw("yellow").raw()
    g = m.raw("green").raw()
    ys, gs = y.schema, g.schema

    def sel(df, s, service, vendor_cols):
        vend = [casts.to_varchar(F.col(c), s[c].dataType) for c in vendor_cols]
        vendor = F.coalesce(*vend) if len(vend) > 1 else vend[0]
        return df.select(
            F.lit(service).alias("service_type"),
            F.col("trip_distance"),
            casts.to_number(F.col("trip_distance"), s["trip_distance"].dataType)
                 .alias("distance_number"),
            casts.to_number(F.col("fare_amount"), s["fare_amount"].dataType)
                 .alias("fare_number"),
            # nineteen and thirty digits, beyond a long
            casts.to_number38(F.concat(F.lit("93"), F.lpad(F.abs(F.floor("trip_distance")).cast("string"), 17, "0"),
                                       F.lit(".5")), T.StringType()).cast("string").alias("number_19"),
            casts.to_number38(F.concat(F.lit("-123456789012345678901234"), F.lpad(F.abs(F.floor(
                "trip_distance")).cast("string"), 6, "0")), T.StringType()).cast("string").alias("number_30"),
            casts.to_varchar(F.col("payment_type"), s["payment_type"].dataType)
                 .alias("payment_code"),
            vendor.alias("vendor_code"),
            fn.code_key(vendor).alias("vendor_key"),
            casts.to_float(F.col("passenger_count"), s["passenger_count"].dataType)
                 .alias("passengers_float"),
        )
    return sel(y, ys, "yellow", ["VendorID"]).unionByName(sel(g, gs, "green", ["vendor_id"]))


# ---- dimensions ------------------------------------------------------------

def q_dim_zones(spark, sf_dir):
    """S2 + P6 + K2: zone lookup written as a CSV with padded cells, read back
    with a header and no inference, cleaned, and stored as a catalog table, read by name."""
    m = _m(spark, sf_dir)
    csv_dir = session.scratch_dir(spark, "zones-csv")
    (testdata.zone_lookup(spark, sf_dir, pad=True).write
     .option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(csv_dir))
    name = f"{m.database}.TAXI_ZONES"
    sinks.replace_table(dims.read_zones_csv(spark, csv_dir), name, session.scratch_dir(spark, "taxi-zones"))
    return spark.table(name)


def q_dim_codes(spark, sf_dir):
    """S4/T6/K4 + Q3: the code tables created from inline VALUES as catalog
    tables; each code seen in the trips, its integer key and the description
    from the tables, read by name (NULL when no row matches)."""
    m = _m(spark, sf_dir)
    names = dims.write_code_tables(spark, m.database, session.scratch_dir(spark, "code-dims"))
    return dims.code_usage(m.trips_all, dims.read_code_tables(spark, names))


# ---- SQL over views ---------------------------------------------------------

def q_read_query(spark, sf_dir):
    """The view chain registered by SQL and a report in SQL text
    (ordinal GROUP BY / ORDER BY) over it: busiest weekdays and hours of a service."""
    m = _m(spark, sf_dir)
    views.register_views(spark, m.trips_all, m.dims)
    return views.read_query(spark, """
        SELECT pickup_dow, service_type, COUNT(DISTINCT pickup_hour) AS hours, COUNT(*) AS trips,
               MAX(trip_minutes) AS longest, SUM(CASE WHEN is_weekend THEN 1 ELSE 0 END) AS weekend_trips
        FROM obt_trips_clean_v GROUP BY 1, 2 HAVING COUNT(*) > 1 ORDER BY 4 DESC, 1, 2""")


# ---- inventories, coverage, load -------------------------------------------

def loaded_months(spark, sf_dir):
    """The months of the trips table, from the catalog."""
    return _m(spark, sf_dir).table.months()


def q_inventory_months(spark, sf_dir):
    """The catalog database that holds every raw month as a table (with a ``_TINY`` sample
    beside each green month, and TRIPS_ALL), its names parsed into (service, year, month); names
    that do not parse are dropped."""
    found = catalog.inventory_months(spark, _m(spark, sf_dir).raw_database)
    # the session catalog folds names to lower case
    return found.withColumn("table_name", F.upper("table_name"))


def q_missing_months(spark, sf_dir):
    """Months missing per service and year over the whole
    calendar years the data spans."""
    loaded = loaded_months(spark, sf_dir)
    expected = coverage.expected_full_years(loaded)
    return coverage.missing_by_year(coverage.missing_months(expected, loaded))


def q_scan_month(spark, sf_dir):
    """One month read back from the monthly files (yellow 1998-07)."""
    m = _m(spark, sf_dir)
    return files.load_month(spark, m.raw_files_root, "yellow", 1998, "07")


def q_inventory_files(spark, sf_dir):
    """Month files per service, year and month, from a recursive listing."""
    m = _m(spark, sf_dir)
    return files.inventory_files(files.list_units(spark, m.raw_files_root))


def q_sample_month(spark, sf_dir):
    """V4: samples of one month (yellow 1998-07) of 25 rows, of none and of all."""
    m = _m(spark, sf_dir)
    parts = [files.load_month(spark, m.raw_files_root, "yellow", 1998, 7, sample=n)
             .withColumn("sample", F.lit(n).cast("int")) for n in (25, 0, None)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def q_overwrite_month(spark, sf_dir):
    """K1: land the trips in a catalog table, land one month again with changed fares and one that
    has become empty, read the whole table by name."""
    m = _m(spark, sf_dir)
    target = MonthlyTable(spark, session.scratch_dir(spark, "trips"))
    target.land(m.trips_all)
    months = F.col("service_type").eqNullSafe("yellow") & (F.col("year") == 1998)
    again = m.trips_all.where(months & (F.col("month") == 7)).withColumn("fare_amount", F.col("fare_amount") + 1)
    target.land(again, {("yellow", 1998, 7): Unit(), ("yellow", 1998, 6): Unit()})
    return spark.table(target.name).select(*TRIPS_ALL_COLUMNS)


def q_load_plan_years(spark, sf_dir):
    """L2: a plan with months named per year (the first half of the first year, single months of
    the last, all of the others), less what is loaded."""
    loaded = loaded_months(spark, sf_dir)
    years = [r["year"] for r in loaded.select("year").distinct().orderBy("year").collect()]
    months = {y: range(1, 13) for y in years} | {years[-1]: (1, 8, 12)} | {years[0]: range(1, 7)}
    return coverage.load_plan(coverage.expected_by_year(spark, months), loaded)


def _file_months(m: Mart) -> DataFrame:
    return files.month_units(m.spark, m.raw_files_root).select("service_type", "year", "month")


def q_load_manifest(spark, sf_dir):
    """L1/L2: plan = every month of the calendar years the source files span;
    load the months found (schema drift harmonised per file signature) and
    report rows and status per planned month."""
    m = _m(spark, sf_dir)
    plan = coverage.expected_full_years(_file_months(m))
    target = session.scratch_dir(spark, "trips-load")
    return ingest.run(spark, plan, m.raw_files_root, target).drop("error")


def q_load_trips(spark, sf_dir):
    """L1: the trips table after a load of every month file, all columns and rows."""
    m = _m(spark, sf_dir)
    target = session.scratch_dir(spark, "trips-loaded")
    ingest.run(spark, _file_months(m), m.raw_files_root, target)
    return sinks.read_trips(spark, target)


def q_load_missing(spark, sf_dir):
    """L2/L3: one service is in the table; the months that both services lack up to
    August of the last year are planned and only those are loaded (their manifest)."""
    m = _m(spark, sf_dir)
    months = _file_months(m)
    target = session.scratch_dir(spark, "trips-missing")
    ingest.run(spark, months.where("service_type = 'yellow'"), m.raw_files_root, target)
    span = months.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).first()
    return ingest.load_missing(spark, m.raw_files_root, target,
                               (span["lo"], 1), (span["hi"], LAST_MONTH)).drop("error")


def q_load_changed(spark, sf_dir):
    """L3: every month is loaded, the yellow months of 1998 are published again with other fares,
    and the next load opens only those: its manifest, and the fares then in the table."""
    m = _m(spark, sf_dir)
    root, target = session.scratch_dir(spark, "raw-changed"), session.scratch_dir(spark, "trips-changed")
    for r in m.raw_services:
        for era in testdata.file_eras(r):
            files.write_months(era, root, r.service, testdata.FILE_YEAR, testdata.FILE_MONTH)
    ingest.load_current(spark, root, target)
    changed = m.raw("yellow").df.where(F.col(testdata.FILE_YEAR) == 1998).withColumn("fare_amount", F.col("fare_amount") + 1)
    files.write_months(changed, root, "yellow", testdata.FILE_YEAR, testdata.FILE_MONTH)
    manifest = ingest.load_current(spark, root, target).drop("error")
    fares = (sinks.read_trips(spark, target).groupBy("service_type", "year", "month")
             .agg(F.sum(F.col("fare_amount").cast(reports.MONEY)).cast("double").alias("fares")))
    return manifest.join(fares, ["service_type", "year", "month"], "left")


def q_load_rejects(spark, sf_dir):
    """Green months are published with text fares, 'n/a' where there is none, and text
    passenger counts; values that no cast can keep, by column."""
    m = _m(spark, sf_dir)
    root, target = session.scratch_dir(spark, "raw-rejects"), session.scratch_dir(spark, "trips-rejects")
    fare, passengers = F.col("fare_amount"), F.col("passenger_count")
    text = m.raw("green").df.withColumns({
        "fare_amount": F.when(fare == 0, F.lit("n/a")).otherwise(fare.cast("string")),
        "passenger_count": F.when(passengers == 4, F.lit("9300000000000000000")).otherwise(passengers.cast("string"))})
    files.write_months(text, root, "green", testdata.FILE_YEAR, testdata.FILE_MONTH)
    ingest.load_current(spark, root, target)
    return (ingest.rejects(spark, target).groupBy("service_type", "column", "raw")
            .agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("column", "column_name"))


def _from_rollup(name: str) -> Query:
    kind, report = rollup.REPORTS[name]

    def query(spark, sf_dir):
        m = _m(spark, sf_dir)
        return report(m.rollup.read(kind, current=True), m.dims)
    query.__doc__ = f"The report {name} from the monthly roll-up; no trip is read."
    return query


QUERIES: dict[str, Query] = {f"rollup_{name}": _from_rollup(name) for name in sorted(rollup.REPORTS)} | {
    name[2:]: fn_ for name, fn_ in sorted(globals().items())
    if name.startswith("q_") and callable(fn_)
}

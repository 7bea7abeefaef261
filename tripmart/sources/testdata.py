"""Adapter: shape the driver's TPC-H-like tables into raw taxi-trip months.

The taxi files themselves are not available, so two services with different
raw schemas are derived from the given tables:

* yellow <- ``lineitem`` (one trip per line item).  Months before 1998 form an
  older schema era: no ``congestion_surcharge`` column and a fractional
  ``passenger_count`` when written as files.
* green  <- ``events`` (one trip per event), with alternate column names
  (``vendor_id``, ``rate_code_id``, ``PU_Location_ID``), text vendor codes and
  no surcharge columns at all.
* zones  <- ``nation`` joined to ``region``.

Every frame is a plain projection of a scan, so it grows with the tables.  The
month a row is "filed" under is carried in ``FILE_YEAR``/``FILE_MONTH`` (as a
file name would), and dropped when months are written as files.  The same
formulas are restated in DuckDB SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.monthly import footer_session

FILE_YEAR, FILE_MONTH = "FILE_YEAR", "FILE_MONTH"
YELLOW_ERA2_START = "1998-01-01"


@dataclass(frozen=True)
class RawMonths:
    """Raw rows of one service; the filed month is in FILE_YEAR/FILE_MONTH."""
    service: str
    df: DataFrame
    table: str

    def raw(self) -> DataFrame:
        return self.df.drop(FILE_YEAR, FILE_MONTH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _secs_after(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)


def yellow(spark: SparkSession, sf_dir: str) -> RawMonths:
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    price = F.col("l_extendedprice") / F.lit(100)
    pickup = _secs_after(F.col("l_shipdate"), (ok * 7919) % 86400)
    dur = (F.floor("l_quantity") * 60 + pk % 997 - 600
           + F.when(ok % 53 == 0, F.lit(18000)).otherwise(F.lit(0)))
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    era2 = F.col("l_shipdate") >= F.lit(YELLOW_ERA2_START).cast("timestamp_ntz")
    df = li.select(
        (sk % 3).alias("VendorID"),
        pickup.alias("tpep_pickup_datetime"),
        _secs_after(pickup, dur).alias("tpep_dropoff_datetime"),
        F.col("l_linenumber").cast("long").alias("passenger_count"),
        F.when(pk % 211 == 0, F.lit(0.0)).when(pk % 307 == 0, F.lit(150.0))
         .otherwise(F.col("l_quantity") / 4).alias("trip_distance"),
        F.col("l_linenumber").cast("double").alias("RatecodeID"),
        F.when(ls == "O", F.lit("N")).otherwise(F.lit("Y")).alias("store_and_fwd_flag"),
        (sk % 27).alias("PULocationID"),
        F.when(pk % 3 == 0, sk % 27).otherwise(pk % 29).alias("DOLocationID"),
        F.when(rf == "A", F.lit(1.0)).when(rf == "R", F.lit(2.0))
         .when(ls == "O", F.lit(3.0)).otherwise(F.lit(9.0)).alias("payment_type"),
        F.when(ok % 97 == 0, F.lit(0.0)).when(ok % 89 == 0, -price)
         .otherwise(price).alias("fare_amount"),
        F.lit(0.5).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        F.when(ok % 83 == 0, price * 6).otherwise(price * F.col("l_discount"))
         .alias("tip_amount"),
        F.when(pk % 10 == 0, F.lit(6.55)).otherwise(F.lit(0.0)).alias("tolls_amount"),
        F.lit(0.3).alias("improvement_surcharge"),
        (price * (F.lit(1) + F.col("l_tax"))).alias("total_amount"),
        F.when(era2, F.lit(2.5)).otherwise(F.lit(None).cast("double"))
         .alias("congestion_surcharge"),
        F.year("l_shipdate").alias(FILE_YEAR),
        F.month("l_shipdate").alias(FILE_MONTH),
    )
    return RawMonths("yellow", df, "lineitem")


def green(spark: SparkSession, sf_dir: str) -> RawMonths:
    ev = table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    df = ev.select(
        F.when(et == "error", F.lit("CMT"))
         .otherwise((F.col("user_id") % 3).cast("string")).alias("vendor_id"),
        # green files store zoned timestamps; ingest normalises them
        F.col("ts").cast("timestamp").alias("lpep_pickup_datetime"),
        _secs_after(F.col("ts"), F.floor(v * 12) - 30).cast("timestamp")
         .alias("lpep_dropoff_datetime"),
        F.lit("N").alias("store_and_fwd_flag"),
        (F.col("event_id") % 7 + 1).alias("rate_code_id"),
        (F.col("user_id") % 26).alias("PU_Location_ID"),
        (F.col("event_id") % 27).alias("DO_Location_ID"),
        (F.col("event_id") % 4 + 1).cast("int").alias("passenger_count"),
        (v / 20).alias("trip_distance"),
        F.when(et == "error", F.lit(0.0)).otherwise(v).alias("fare_amount"),
        F.lit(0.5).alias("mta_tax"),
        F.when(et == "purchase", v * 0.2).when(et == "click", v * 0.1)
         .otherwise(F.lit(0.0)).alias("tip_amount"),
        F.lit(0.0).alias("tolls_amount"),
        (v * 1.1 + 0.5).alias("total_amount"),
        F.when(et == "purchase", F.lit(1)).when(et == "click", F.lit(2))
         .when(et == "view", F.lit(3)).when(et == "signup", F.lit(4))
         .otherwise(F.lit(5)).cast("long").alias("payment_type"),
        F.lit(1).cast("long").alias("trip_type"),
        F.year("ts").alias(FILE_YEAR),
        F.month("ts").alias(FILE_MONTH),
    )
    return RawMonths("green", df, "events")


def file_eras(raw: RawMonths) -> list[DataFrame]:
    """The raw rows split into schema eras, as the monthly files hold them.

    Yellow months before 1998 lack ``congestion_surcharge`` and store
    ``passenger_count`` as a double; later yellow months and green keep the
    adapter's schema.  Each frame keeps FILE_YEAR/FILE_MONTH.
    """
    if raw.service != "yellow":
        return [raw.df]
    old = F.col(FILE_YEAR) < int(YELLOW_ERA2_START[:4])
    era1 = (raw.df.where(old).drop("congestion_surcharge")
            .withColumn("passenger_count", F.col("passenger_count").cast("double")))
    return [era1, raw.df.where(~old)]


def services(spark: SparkSession, sf_dir: str) -> list[RawMonths]:
    return [yellow(spark, sf_dir), green(spark, sf_dir)]


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each service's raw table, from its Parquet footers."""
    footers = footer_session(spark)
    parts = [table(footers, sf_dir, name).agg(F.count(F.lit(1)).alias("rows")) for name in ("lineitem", "events")]
    return parts[0].unionByName(parts[1])


def zone_lookup(spark: SparkSession, sf_dir: str, pad: bool = False) -> DataFrame:
    """Zone lookup rows as the CSV holds them (all strings).

    ``pad`` surrounds names with blanks, as hand-edited CSVs often do, so the
    dimension clean-up (trim) has work to do.
    """
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)

    def p(c):
        return F.concat(F.lit(" "), c, F.lit(" ")) if pad else c
    return j.select(
        p(F.col("n_nationkey").cast("string")).alias("LocationID"),
        p(F.col("r_name")).alias("Borough"),
        p(F.col("n_name")).alias("Zone"),
        p(F.when(F.col("r_name") == "AMERICA", F.lit("Yellow Zone"))
          .otherwise(F.lit("Boro Zone"))).alias("service_zone"),
    )

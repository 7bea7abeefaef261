"""Canonical schema of the unified trips table and the raw-column candidates."""

from __future__ import annotations

from pyspark.sql import types as T

# Candidate raw names per canonical column (first present wins,
# compared case-insensitively), the warehouse type each is cast to, and the
# canonical name.  Order is the column order of the unified table.
PICKUP_CANDIDATES = ["TPEP_PICKUP_DATETIME", "LPEP_PICKUP_DATETIME", "PICKUP_DATETIME"]
DROPOFF_CANDIDATES = ["TPEP_DROPOFF_DATETIME", "LPEP_DROPOFF_DATETIME", "DROPOFF_DATETIME"]
COLUMN_MAP = [
    (PICKUP_CANDIDATES, "timestamp", "pickup_datetime"),
    (DROPOFF_CANDIDATES, "timestamp", "dropoff_datetime"),
    (["PASSENGER_COUNT"], "number", "passenger_count"),
    (["TRIP_DISTANCE"], "float", "trip_distance"),
    (["PULOCATIONID", "PU_LOCATION_ID"], "number", "pu_location_id"),
    (["DOLOCATIONID", "DO_LOCATION_ID"], "number", "do_location_id"),
    (["FARE_AMOUNT"], "float", "fare_amount"),
    (["TIP_AMOUNT"], "float", "tip_amount"),
    (["TOLLS_AMOUNT"], "float", "tolls_amount"),
    (["MTA_TAX"], "float", "mta_tax"),
    (["IMPROVEMENT_SURCHARGE"], "float", "improvement_surcharge"),
    (["CONGESTION_SURCHARGE"], "float", "congestion_surcharge"),
    (["TOTAL_AMOUNT"], "float", "total_amount"),
    (["PAYMENT_TYPE"], "varchar", "payment_type"),
    (["VENDORID", "VENDOR_ID"], "varchar", "vendor_id"),
    (["RATECODEID", "RATE_CODE_ID"], "varchar", "rate_code_id"),
    (["STORE_AND_FWD_FLAG"], "varchar", "store_and_fwd_flag"),
]

# Raw time columns normalised to plain timestamps at ingest.
RAW_TIME_COLUMNS = ["tpep_pickup_datetime", "tpep_dropoff_datetime",
                    "lpep_pickup_datetime", "lpep_dropoff_datetime"]

TRIPS_ALL_SCHEMA = T.StructType([
    T.StructField("service_type", T.StringType()),
    T.StructField("pickup_datetime", T.TimestampNTZType()),
    T.StructField("dropoff_datetime", T.TimestampNTZType()),
    T.StructField("passenger_count", T.LongType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("pu_location_id", T.LongType()),
    T.StructField("do_location_id", T.LongType()),
    T.StructField("fare_amount", T.DoubleType()),
    T.StructField("tip_amount", T.DoubleType()),
    T.StructField("tolls_amount", T.DoubleType()),
    T.StructField("mta_tax", T.DoubleType()),
    T.StructField("improvement_surcharge", T.DoubleType()),
    T.StructField("congestion_surcharge", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("vendor_id", T.StringType()),
    T.StructField("rate_code_id", T.StringType()),
    T.StructField("store_and_fwd_flag", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])
TRIPS_ALL_COLUMNS = [f.name for f in TRIPS_ALL_SCHEMA.fields]
PARTITION_COLUMNS = ["service_type", "year", "month"]

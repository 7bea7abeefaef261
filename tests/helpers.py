import datetime as dt

from pyspark.sql import types as T

from tripmart.schema import TRIPS_ALL_SCHEMA


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def trips(spark, rows: list[dict]):
    """Canonical trips from partial dicts (missing fields NULL)."""
    defaults = {"service_type": "yellow", "year": 2020, "month": 1, "trip_distance": 2.0,
                "fare_amount": 10.0, "tip_amount": 1.0, "pu_location_id": 1,
                "do_location_id": 2}
    names = [f.name for f in TRIPS_ALL_SCHEMA.fields]
    data = [tuple({**defaults, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, TRIPS_ALL_SCHEMA)


def zones(spark, rows):
    schema = T.StructType([T.StructField("LOCATIONID", T.IntegerType()),
                           T.StructField("BOROUGH", T.StringType()),
                           T.StructField("ZONE", T.StringType()),
                           T.StructField("SERVICE_ZONE", T.StringType())])
    return spark.createDataFrame(rows, schema)

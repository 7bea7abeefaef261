"""Monthly roll-up of the trips table: reports R4-R13 without reading trips.

Three catalog tables of mergeable partial aggregates, one row per month and key:

* ``profile`` of clean trips: hour, weekday, weekend flag (R4-R6);
* ``places`` of strict trips: pickup and dropoff zone ids (R7-R10, R12);
* ``fares`` of strict trips: payment code, pickup hour (R11, R13).

Each is a ``MonthlyTable`` beside the trips, whose ledger says of which load a month was made.
``refresh`` makes again only the months that a load has touched since (all of them, beside the old
ones, once the code that makes them is another).  Zone names and code
descriptions are joined after the aggregate, so a new lookup needs no refresh.

Sums are mergeable in any order: values below 10^15 are summed as decimals with 12 places, so a
total doesn't depend on how trips were split over tasks or loads; others (and NaN, infinite) are
summed aside as doubles.  A NULL is left out of a sum and of its count.
"""

from __future__ import annotations

import sys
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import code_key, ratio, seconds_between, speed_mph, time
from ..schema import PARTITION_COLUMNS, TRIPS_ALL_SCHEMA
from ..sinks.monthly import MonthlyTable, Unit, code_digest, month_filter
from . import marts, reports
from .dims import CODE_DIMS, Dims

EXACT, EXACT_BELOW = "decimal(38,12)", 1e15
MONEY_SUM = "decimal(38,6)"


def _exact_sum(column: str, decimal: str, digits: int, where: str = "true") -> Column:
    """Sum of a double column cast to ``decimal``, which has ``digits`` places; NULL of no value.

    Decimals of single rows are made only where they have to be.  A value below 10^14 units of the last
    place, times those, is off by less than 0.03 units; unless it lies that close to a half, its
    nearest integer is what the cast gives.  Those integers are summed as two longs, in and below millions."""
    scaled = f"(`{column}` * 1e{digits}D)"
    unit = f"CAST(floor({scaled} + 0.5D) AS BIGINT)"
    quick = f"(coalesce(abs({scaled}) < 1e14D AND abs({scaled} - floor({scaled}) - 0.5D) > 0.03D, false) AND {where})"

    def places(x, n):
        return x.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-n))
    upper, lower = (F.expr(f"sum({unit} {op} 1000000) FILTER (WHERE {quick})") for op in ("DIV", "%"))
    by_units = (places(upper, digits - 6) + places(lower, digits)).cast(f"decimal(34,{digits})")
    others = f"NOT {quick} AND {where}"               # in the cast too: filters may come after it
    one_by_one = F.expr(f"sum(CAST(CASE WHEN {others} THEN `{column}` END AS {decimal})) FILTER (WHERE {others})").cast(f"decimal(37,{digits})")
    return F.coalesce(by_units + one_by_one, by_units, one_by_one)


def _total(name: str, column: str) -> list[Column]:
    """Mergeable sum and count of a double column."""
    small = f"abs(`{column}`) < {EXACT_BELOW}D"
    return [F.coalesce(_exact_sum(column, EXACT, 12, small), F.lit(0).cast(EXACT)).cast(EXACT).alias(f"{name}_sum"),
            F.expr(f"sum(`{column}`) FILTER (WHERE NOT ({small}))").alias(f"{name}_rest"), F.count(column).alias(f"{name}_n")]


def _mean(name: str, digits: int) -> Column:
    """ROUND(AVG, digits) over merged rows, by decimal division, so halves are true halves; NULL where
    nothing was counted."""
    n = F.nullif(F.sum(f"{name}_n"), F.lit(0))
    total, rest = F.sum(f"{name}_sum"), F.sum(f"{name}_rest")
    exact = F.round(total.try_cast("decimal(28,12)") / n.try_cast("decimal(12,0)"), digits).cast("double")
    return F.coalesce(F.when(rest.isNull(), exact),
                      F.round((total.cast("double") + F.coalesce(rest, F.lit(0.0))) / n, digits))


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def profile(trips: DataFrame) -> DataFrame:
    t = marts.clean(marts.obt(trips))
    return t.groupBy(*PARTITION_COLUMNS, "pickup_hour", "pickup_dow", "is_weekend").agg(
        _count(), F.sum("trip_minutes").alias("minutes"), *_total("distance", "trip_distance"),
        *_total("tip", "tip_pct"))


def places(trips: DataFrame) -> DataFrame:
    speed = speed_mph("trip_distance", seconds_between("pickup_datetime", "dropoff_datetime"))
    t = marts.strict(trips).withColumn("speed", speed)
    return t.groupBy(*PARTITION_COLUMNS, "pu_location_id", "do_location_id").agg(
        _count(), _exact_sum("total_amount", reports.MONEY, 6).cast(MONEY_SUM).alias("money"),
        *_total("tip", "tip_pct"), *_total("speed", "speed"),
        F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"))


def fares(trips: DataFrame) -> DataFrame:
    return marts.strict(trips).groupBy(*PARTITION_COLUMNS, "payment_type", "pickup_hour").agg(
        _count(), F.sum("trip_duration_min").alias("minutes"), *_total("distance", "trip_distance"),
        *_total("tip", "tip_pct"))


KINDS = {"profile": profile, "places": places, "fares": fares}


class Rollup:
    """The roll-up of a trips table; its tables are named after it."""

    def __init__(self, trips: MonthlyTable):
        self.trips = trips
        rules = code_digest(sys.modules[__name__], marts, time, ratio, schema)
        self.tables = {kind: MonthlyTable(trips.spark, f"{trips.root}/rollup/{rules}/{kind}", f"{trips.name}_{kind}_{rules}",
                                          _schema(trips.spark, make)) for kind, make in KINDS.items()}

    def refresh(self) -> dict[str, list]:
        """Make the months again whose load isn't the one they were made of; returns them by kind."""
        loads = self.trips.current().select(*PARTITION_COLUMNS, "load")
        done = {}
        for kind, table in self.tables.items():
            made = table.current().select(*PARTITION_COLUMNS, F.col("fingerprint").alias("made"))
            stale = {(r[0], r[1], r[2]): Unit(None, r[3]) for r in loads.join(made, PARTITION_COLUMNS, "left")
                     .where(~F.col("load").eqNullSafe(F.col("made"))).select(*PARTITION_COLUMNS, "load").collect()}
            if stale:
                months = self.trips.read().where(month_filter(stale))
                table.land(KINDS[kind](months), stale, rebalance=True)
            done[kind] = sorted(stale)
        return done

    def read(self, kind: str, current: bool = False) -> DataFrame:
        """One of the tables by name; ``current`` says that it was refreshed or opened before."""
        table = self.tables[kind]
        return self.trips.spark.table(table.name) if current else table.read()


def _schema(spark: SparkSession, make) -> T.StructType:
    made = make(spark.createDataFrame([], TRIPS_ALL_SCHEMA)).schema
    return T.StructType([T.StructField(f.name, f.dataType) for f in made])


# ---------------------------------------------------------------- reports

def _asc(*cols):
    return [F.col(c).asc_nulls_last() for c in cols]


def _profile_report(df: DataFrame, keys: list[str], first_n: bool) -> DataFrame:
    n = F.sum("n").alias("n")
    means = [F.round(F.sum("minutes") / F.sum("n"), 1).alias("avg_min"), _mean("distance", 2).alias("avg_dist"),
             _mean("tip", 3).alias("avg_tip")]
    return df.groupBy(*keys).agg(*([n, *means] if first_n else [*means, n])).orderBy(*_asc(*keys))


def stats_by_service(profile_df: DataFrame) -> DataFrame:
    """R4."""
    return _profile_report(profile_df, ["service_type"], False)


def stats_by_hour_service(profile_df: DataFrame) -> DataFrame:
    """R5."""
    return _profile_report(profile_df, ["pickup_hour", "service_type"], True)


def stats_by_dow(profile_df: DataFrame) -> DataFrame:
    """R6."""
    return _profile_report(profile_df, ["pickup_dow", "is_weekend", "service_type"], True)


def _named(df: DataFrame, dims: Dims, *sides: str) -> DataFrame:
    """``df`` with borough and zone of the sides' location ids."""
    for side in sides:
        z = dims.zones.select(F.col("LOCATIONID").alias(f"_{side}"), F.col("ZONE").alias(f"{side}_zone"),
                              F.col("BOROUGH").alias(f"{side}_borough"))
        df = df.join(F.broadcast(z) if dims.zones_small else z, F.col(f"{side}_location_id") == F.col(f"_{side}"), "left")
    return df


def top_zones(places_df: DataFrame, dims: Dims, side: str = "pu", k: int = reports.TOP_ZONES) -> DataFrame:
    """Ids are summed first, so only one row for each zone and month meets the lookup."""
    b, z = f"{side}_borough", f"{side}_zone"
    ids = places_df.groupBy("year", "month", f"{side}_location_id").agg(F.sum("n").alias("n"))
    counts = _named(ids, dims, side).groupBy("year", "month", b, z).agg(F.sum("n").alias("trips"))
    w = Window.partitionBy("year", "month").orderBy(F.col("trips").desc(), *_asc(b, z))
    return (counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
            .orderBy(*_asc("year", "month"), F.col("trips").desc(), *_asc(b, z)))


def revenue_by_borough_month(places_df: DataFrame, dims: Dims) -> DataFrame:
    """R9."""
    return (_named(places_df, dims, "pu").groupBy("year", "month", "pu_borough")
            .agg(F.round(F.sum("money"), 2).cast("double").alias("total_amount_sum"),
                 _mean("tip", 3).alias("tip_pct_avg"), F.sum("n").alias("n"))
            .orderBy(*_asc("year", "month", "pu_borough")))


def speed_by_borough(places_df: DataFrame, dims: Dims) -> DataFrame:
    """R10."""
    return (_named(places_df.where("speed_n > 0"), dims, "pu").groupBy("pu_borough")
            .agg(_mean("speed", 2).alias("avg_speed"), F.round(F.min("speed_min"), 2).alias("min_speed"),
                 F.round(F.max("speed_max"), 2).alias("max_speed"))
            .orderBy(F.col("avg_speed").desc_nulls_first(), *_asc("pu_borough")))


def top_corridors_tip(places_df: DataFrame, dims: Dims, min_trips: int = reports.CORRIDOR_MIN_TRIPS,
                      k: int = reports.CORRIDOR_TOP) -> DataFrame:
    """R12."""
    keys = ["pu_borough", "pu_zone", "do_borough", "do_zone"]
    return (_named(places_df.where("tip_n > 0"), dims, "pu", "do").groupBy(*keys)
            .agg(_mean("tip", 3).alias("avg_tip_pct"), F.sum("tip_n").alias("n"))
            .where(F.col("n") > min_trips).orderBy(F.col("avg_tip_pct").desc_nulls_first(), *_asc(*keys)).limit(k))


def tip_by_payment(fares_df: DataFrame, dims: Dims) -> DataFrame:
    """R11."""
    key, desc, _rows = CODE_DIMS["payment"]
    d = dims.codes["payment"].select(F.col(key).alias("_key"), desc)
    named = fares_df.where("tip_n > 0").join(F.broadcast(d) if dims.codes_small else d,
                                             code_key(F.col(key)) == F.col("_key"), "left")
    return (named.groupBy(desc).agg(_mean("tip", 3).alias("avg_tip_pct"), F.sum("tip_n").alias("n"))
            .orderBy(F.col("avg_tip_pct").desc_nulls_first(), *_asc(desc)))


def stats_by_hour(fares_df: DataFrame) -> DataFrame:
    """R13."""
    return (fares_df.groupBy("pickup_hour")
            .agg(F.round(F.sum("minutes") / F.sum("n"), 2).alias("avg_duration_min"),
                 _mean("distance", 2).alias("avg_distance_mi"), _mean("tip", 3).alias("avg_tip_pct"),
                 F.sum("n").alias("n")).orderBy(*_asc("pickup_hour")))


#: Report -> (kind, its function over that table and the dimensions).
REPORTS = {
    "stats_by_service": ("profile", lambda t, d: stats_by_service(t)),
    "stats_by_hour_service": ("profile", lambda t, d: stats_by_hour_service(t)),
    "stats_by_dow": ("profile", lambda t, d: stats_by_dow(t)),
    "top_pickup_zones": ("places", lambda t, d: top_zones(t, d, "pu")),
    "top_dropoff_zones": ("places", lambda t, d: top_zones(t, d, "do")),
    "revenue_by_borough_month": ("places", revenue_by_borough_month),
    "speed_by_borough": ("places", speed_by_borough),
    "tip_by_payment": ("fares", tip_by_payment),
    "top_corridors_tip": ("places", top_corridors_tip),
    "stats_by_hour": ("fares", lambda t, d: stats_by_hour(t)),
}

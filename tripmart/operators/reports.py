"""Reports R1, R4-R13: grouped aggregates with rounding and explicit order.

Every report is a hash aggregate (map-side partial, then a shuffle of at most
one row per group and task), so a key holding a third of all rows costs no
more than any other key.  Orderings spell out NULL placement as the warehouse
does it (ASC NULLS LAST, DESC NULLS FIRST), and every ranking carries
tie-break keys so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The report contract of the source.
# Output column names, per report:
#   R1  service_type, year, total_viajes
#   R2  trips_negativos, tips_negativos, tips_mayor_500pct
#   R3  total_clean, pct_sobre_total
#   R4  service_type, avg_min, avg_dist, avg_tip, n
#   R5  pickup_hour, service_type, n, avg_min, avg_dist, avg_tip
#   R6  pickup_dow, is_weekend, service_type, n, avg_min, avg_dist, avg_tip
#   R7  year, month, pu_borough, pu_zone, trips
#   R8  year, month, do_borough, do_zone, trips
#   R9  year, month, pu_borough, total_amount_sum, tip_pct_avg, n
#   R10 pu_borough, avg_speed, min_speed, max_speed
#   R11 payment_type_desc, avg_tip_pct, n
#   R12 pu_borough, pu_zone, do_borough, do_zone, avg_tip_pct, n
#   R13 pickup_hour, avg_duration_min, avg_distance_mi, avg_tip_pct, n
# Rounding: minutes 1 decimal (R4-R6), distances, money and speeds 2, tip shares 3
# (R13 rounds minutes to 2).  Top zones per month: 10.  Corridors: more than
# 500 trips, top 10.  Tip share above 5 counts as "above 500 %".
TOP_ZONES = 10
CORRIDOR_MIN_TRIPS = 500
CORRIDOR_TOP = 10


def _asc(*cols):
    return [F.col(c).asc_nulls_last() for c in cols]


def _profile(df: DataFrame, keys: list[str], *, first_n: bool) -> DataFrame:
    measures = [F.round(F.avg("trip_minutes"), 1).alias("avg_min"),
                F.round(F.avg("trip_distance"), 2).alias("avg_dist"),
                F.round(F.avg("tip_pct"), 3).alias("avg_tip")]
    n = F.count(F.lit(1)).alias("n")
    aggs = [n, *measures] if first_n else [*measures, n]
    return df.groupBy(*keys).agg(*aggs).orderBy(*_asc(*keys))


def trips_by_service_year(trips: DataFrame) -> DataFrame:
    """Trips per service and year."""
    return (trips.groupBy("service_type", "year")
            .agg(F.count(F.lit(1)).alias("total_viajes"))
            .orderBy(*_asc("service_type", "year")))


def trips_by_service_year_of(counts: DataFrame) -> DataFrame:
    """R1 from the rows of each month (``MonthlyTable.counts``): footers are read, no trip is."""
    return (counts.groupBy("service_type", "year")
            .agg(F.sum("rows").alias("total_viajes"))
            .orderBy(*_asc("service_type", "year")))


def stats_by_service(clean_df: DataFrame) -> DataFrame:
    """Average minutes, distance, tip share and count per service."""
    return _profile(clean_df, ["service_type"], first_n=False)


def stats_by_hour_service(clean_df: DataFrame) -> DataFrame:
    """The same per pickup hour and service."""
    return _profile(clean_df, ["pickup_hour", "service_type"], first_n=True)


def stats_by_dow(clean_df: DataFrame) -> DataFrame:
    """The same per weekday name, weekend flag and service."""
    return _profile(clean_df, ["pickup_dow", "is_weekend", "service_type"], first_n=True)


def top_zones(enriched: DataFrame, side: str = "pu", k: int = TOP_ZONES) -> DataFrame:
    """The k zones with most trips per month (pickup or dropoff side).

    Aggregate first (partial + final), then rank within (year, month): after
    the aggregate a month holds at most one row per zone, and Spark plans the
    ``row_number() <= k`` filter as a partial WindowGroupLimit before the
    shuffle.  Ties on trips go to the lower (borough, zone).
    """
    b, z = f"{side}_borough", f"{side}_zone"
    counts = enriched.groupBy("year", "month", b, z).agg(F.count(F.lit(1)).alias("trips"))
    w = Window.partitionBy("year", "month").orderBy(
        F.col("trips").desc(), F.col(b).asc_nulls_last(), F.col(z).asc_nulls_last())
    return (counts.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= k).drop("_rn")
            .orderBy(F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last(),
                     F.col("trips").desc(), *_asc(b, z)))


# Money is summed as an exact decimal: a double sum depends on the order in
# which tasks add their partials, so a total on a .xx5 edge could round
# either way from run to run.  Each amount is rounded to six digits first.
MONEY = "decimal(18,6)"


def revenue_by_borough_month(enriched: DataFrame) -> DataFrame:
    """Revenue, tip share and count per month and pickup borough."""
    return (enriched.groupBy("year", "month", "pu_borough")
            .agg(F.round(F.sum(F.col("total_amount").cast(MONEY)), 2).cast("double")
                  .alias("total_amount_sum"),
                 F.round(F.avg("tip_pct"), 3).alias("tip_pct_avg"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(*_asc("year", "month", "pu_borough")))


def speed_by_borough(enriched: DataFrame) -> DataFrame:
    """average/min/max speed per pickup borough, known speeds only."""
    return (enriched.where(F.col("avg_speed_mph").isNotNull())
            .groupBy("pu_borough")
            .agg(F.round(F.avg("avg_speed_mph"), 2).alias("avg_speed"),
                 F.round(F.min("avg_speed_mph"), 2).alias("min_speed"),
                 F.round(F.max("avg_speed_mph"), 2).alias("max_speed"))
            .orderBy(F.col("avg_speed").desc_nulls_first(), *_asc("pu_borough")))


def tip_by_payment(enriched: DataFrame) -> DataFrame:
    """Average tip share and count per payment description."""
    return (enriched.where(F.col("tip_pct").isNotNull())
            .groupBy("payment_type_desc")
            .agg(F.round(F.avg("tip_pct"), 3).alias("avg_tip_pct"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("avg_tip_pct").desc_nulls_first(), *_asc("payment_type_desc")))


def top_corridors_tip(enriched: DataFrame, min_trips: int = CORRIDOR_MIN_TRIPS,
                      k: int = CORRIDOR_TOP) -> DataFrame:
    """The k pickup->dropoff zone pairs with the highest average tip share
    among pairs with more than ``min_trips`` trips (HAVING), ties by keys."""
    keys = ["pu_borough", "pu_zone", "do_borough", "do_zone"]
    return (enriched.where(F.col("tip_pct").isNotNull())
            .groupBy(*keys)
            .agg(F.round(F.avg("tip_pct"), 3).alias("avg_tip_pct"),
                 F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > min_trips)
            .orderBy(F.col("avg_tip_pct").desc_nulls_first(), *_asc(*keys))
            .limit(k))


def stats_by_hour(enriched: DataFrame) -> DataFrame:
    """Duration, distance, tip share and count per pickup hour."""
    return (enriched.groupBy("pickup_hour")
            .agg(F.round(F.avg("trip_duration_min"), 2).alias("avg_duration_min"),
                 F.round(F.avg("trip_distance"), 2).alias("avg_distance_mi"),
                 F.round(F.avg("tip_pct"), 3).alias("avg_tip_pct"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(*_asc("pickup_hour")))

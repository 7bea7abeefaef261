"""SQL forms of the warehouse functions equal the Column functions on every trip."""

from pyspark.sql import functions as F

from tripmart import functions as fn
from tripmart.functions.sql import register_sql_functions
from tripmart.plans.mart import Mart
from tests.conftest import SF_SMALL


def test_sql_functions_match_column_functions(spark):
    register_sql_functions(spark)
    t = Mart(spark, SF_SMALL).trips_all
    p, d = F.col("pickup_datetime"), F.col("dropoff_datetime")
    secs = fn.seconds_between(p, d)
    both = t.select(
        (fn.minutes_between(p, d).eqNullSafe(
            F.expr("datediff_boundary('minute', pickup_datetime, dropoff_datetime)"))).alias("m"),
        (secs.eqNullSafe(
            F.expr("datediff_boundary('second', pickup_datetime, dropoff_datetime)"))).alias("s"),
        (fn.day_name(p).eqNullSafe(F.expr("day_abbrev(pickup_datetime)"))).alias("dy"),
        (fn.is_weekend(p).eqNullSafe(F.expr("is_weekend(pickup_datetime)"))).alias("we"),
        ((F.dayofweek(p) - 1).isin(0, 6).eqNullSafe(F.expr("dayofweek_sun0(pickup_datetime) IN (0, 6)")))
         .alias("dow"),
        (fn.tip_pct().eqNullSafe(F.expr("tip_pct(tip_amount, fare_amount)"))).alias("tip"),
        (fn.speed_mph("trip_distance", secs).eqNullSafe(F.expr(
            "speed_mph(trip_distance, datediff_boundary('second', pickup_datetime, dropoff_datetime))")))
         .alias("speed"),
        (fn.code_key("payment_type").eqNullSafe(F.expr("code_key(payment_type)"))).alias("code"),
    )
    bad = both.where(~F.expr("m AND s AND dy AND we AND dow AND tip AND speed AND code")).count()
    assert bad == 0

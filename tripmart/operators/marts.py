"""Marts: the One-Big-Table, its cleaning rule sets and the enriched view.

T2 ``obt``, T3 ``clean``, T4 ``strict`` and T7 ``enrich`` are lazy DataFrame
transforms, like the warehouse views they replace; Catalyst pushes the
bare-column parts of each rule into the scan and prunes unused columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (code_key, date_of, day_name, hour_of, is_weekend, minutes_between,
                         seconds_between, speed_mph, tip_pct)
from .dims import CODE_DIMS, Dims

PASS_THROUGH = ["trip_distance", "pu_location_id", "do_location_id", "fare_amount",
                "tip_amount", "tolls_amount", "mta_tax", "improvement_surcharge",
                "congestion_surcharge", "total_amount", "payment_type", "vendor_id",
                "rate_code_id", "store_and_fwd_flag", "year", "month"]


def obt(trips: DataFrame, duration: str = "trip_minutes") -> DataFrame:
    """Trips + duration, hour, weekday, weekend flag, tip share (24 cols).

    ``passenger_count`` is not carried, as in the source view.
    """
    return trips.select(
        "service_type", "pickup_datetime", "dropoff_datetime",
        minutes_between("pickup_datetime", "dropoff_datetime").alias(duration),
        hour_of("pickup_datetime").alias("pickup_hour"),
        day_name("pickup_datetime").alias("pickup_dow"),
        is_weekend("pickup_datetime").alias("is_weekend"),
        *PASS_THROUGH,
        tip_pct("tip_amount", "fare_amount").alias("tip_pct"),
    )


# Bounds of the two cleaning rule sets, as the source defines them.
# clean:  minutes 1..240, distance above 0 and at most 100, tip share 0..1
# strict: fare above 0, distance 0.1..100, minutes 1..240
CLEAN_MINUTES = (1, 240)
CLEAN_MAX_DISTANCE = 100
CLEAN_TIP_SHARE = (0, 1)
STRICT_DISTANCE = (0.1, 100)
STRICT_MINUTES = (1, 240)


# Named rule sets (W1, W2).  Bounds are inclusive (BETWEEN); a NULL in a
# tested column drops the row.
def clean_rule(duration: str = "trip_minutes") -> Column:
    """1..240 min, 0 < distance <= 100, tip share in 0..1."""
    return (F.col(duration).between(*CLEAN_MINUTES)
            & (F.col("trip_distance") > 0) & (F.col("trip_distance") <= CLEAN_MAX_DISTANCE)
            & F.col("tip_pct").between(*CLEAN_TIP_SHARE))


def strict_rule(duration: str = "trip_duration_min") -> Column:
    """Fare > 0, 0.1 <= distance <= 100, 1..240 min."""
    return ((F.col("fare_amount") > 0)
            & F.col("trip_distance").between(*STRICT_DISTANCE)
            & F.col(duration).between(*STRICT_MINUTES))


RULES = {"clean": clean_rule, "strict": strict_rule}


def clean(obt_df: DataFrame) -> DataFrame:
    """The clean view over the OBT."""
    return obt_df.where(clean_rule("trip_minutes"))


def strict(trips: DataFrame) -> DataFrame:
    """T4: OBT with ``trip_duration_min`` and the strict rule in one step."""
    return obt(trips, "trip_duration_min").where(strict_rule("trip_duration_min"))


ALL_ROLES = ("pu", "do", "payment", "vendor", "rate")
ROLE_COLUMNS = {
    "pu": ("pu_zone", "pu_borough"),
    "do": ("do_zone", "do_borough"),
    "payment": ("payment_type_desc",),
    "vendor": ("vendor_name",),
    "rate": ("rate_code_desc",),
}


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def enrich(strict_df: DataFrame, dims: Dims, roles=ALL_ROLES) -> DataFrame:
    """P8/T7 + J1-J3: five LEFT joins and the derived calendar/speed columns.

    ``roles`` limits the joins to the dimensions a caller reads.  A skipped
    join must not change row counts, so a role is only skipped when its key
    is unique (checked in ``build_dims``; the inline code tables are unique
    by construction).  Dimensions are broadcast only when their checked
    size bound holds.  The output columns are always all present; a
    skipped role's columns are typed NULLs.
    """
    roles = set(roles)
    if not dims.zones_unique:
        roles |= {"pu", "do"}
    if not dims.codes_unique:
        roles |= set(CODE_DIMS)
    t = strict_df
    for side in ("pu", "do"):
        if side in roles:
            z = dims.zones.select(F.col("LOCATIONID").alias(f"_{side}_key"),
                                  F.col("ZONE").alias(f"{side}_zone"),
                                  F.col("BOROUGH").alias(f"{side}_borough"))
            t = t.join(_hint(z, dims.zones_small),
                       F.col(f"{side}_location_id") == F.col(f"_{side}_key"), "left")
        else:
            t = t.withColumns({f"{side}_zone": F.lit(None).cast("string"),
                               f"{side}_borough": F.lit(None).cast("string")})
    for role, (key, desc, _rows) in CODE_DIMS.items():
        if role in roles:
            d = dims.codes[role].select(F.col(key).alias(f"_{role}_key"), desc)
            t = t.join(_hint(d, dims.codes_small),
                       code_key(F.col(key)) == F.col(f"_{role}_key"), "left")
        else:
            t = t.withColumn(desc, F.lit(None).cast("string"))
    return t.select(
        "service_type", "pickup_datetime", "dropoff_datetime",
        date_of("pickup_datetime").alias("pickup_date"),
        date_of("dropoff_datetime").alias("dropoff_date"),
        hour_of("pickup_datetime").alias("pickup_hour"),
        hour_of("dropoff_datetime").alias("dropoff_hour"),
        day_name("pickup_datetime").alias("day_of_week"),
        "year", "month",
        "pu_location_id", "pu_zone", "pu_borough",
        "do_location_id", "do_zone", "do_borough",
        "trip_distance", "store_and_fwd_flag", "fare_amount", "tip_amount", "tolls_amount",
        "mta_tax", "improvement_surcharge", "congestion_surcharge", "total_amount",
        "payment_type", "payment_type_desc", "vendor_id", "vendor_name",
        "rate_code_id", "rate_code_desc",
        F.lit(None).cast("int").alias("trip_type"),
        "trip_duration_min", "tip_pct",
        speed_mph("trip_distance",
                  seconds_between("pickup_datetime", "dropoff_datetime")).alias("avg_speed_mph"),
    )

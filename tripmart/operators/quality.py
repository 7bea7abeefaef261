"""Quality and reconciliation counts.

Each report is one pass: conditional counts are evaluated side by side in a
single global aggregate (partial per task, one final row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marts import clean_rule

# Fixed value: a tip share above this counts as "above 500 %" (R2).
TIP_SHARE_ALERT = 5


def quality_counts(obt_df: DataFrame) -> DataFrame:
    """R2: negative durations, negative tip shares, tip share above 500 %."""
    return obt_df.agg(
        F.count_if(F.col("trip_minutes") < 0).alias("trips_negativos"),
        F.count_if(F.col("tip_pct") < 0).alias("tips_negativos"),
        F.count_if(F.col("tip_pct") > TIP_SHARE_ALERT).alias("tips_mayor_500pct"),
    )


def clean_pct(obt_df: DataFrame) -> DataFrame:
    """Rows kept by the clean rule and their share of the OBT (in %).

    The denominator is counted in the same pass instead of being a literal.
    """
    agg = obt_df.agg(F.count_if(clean_rule("trip_minutes")).alias("total_clean"),
                     F.count(F.lit(1)).alias("_total"))
    return agg.select(
        "total_clean",
        F.round(F.col("total_clean") / F.nullif(F.col("_total"), F.lit(0)) * 100, 2)
         .alias("pct_sobre_total"))


def row_counts(trips: DataFrame, obt_df: DataFrame) -> DataFrame:
    """L4: OBT rows against unified rows, one row with an equality flag.

    Both inputs are reduced to a tag column and counted in one aggregate (no
    join of two one-row results).
    """
    tagged = (trips.select(F.lit(0).alias("_src"))
              .unionByName(obt_df.select(F.lit(1).alias("_src"))))
    agg = tagged.agg(F.count_if(F.col("_src") == 0).alias("trips_all_rows"),
                     F.count_if(F.col("_src") == 1).alias("obt_rows"))
    return agg.withColumn("counts_match", F.col("trips_all_rows") == F.col("obt_rows"))


def reconcile(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """L4 from counts: both inputs have a column ``rows`` (of a source table, of a month); the OBT
    has one row for each loaded trip."""
    tagged = (source.select(F.lit(0).alias("_src"), "rows")
              .unionByName(loaded.select(F.lit(1).alias("_src"), "rows")))

    def total(i):
        return F.coalesce(F.sum(F.when(F.col("_src") == i, F.col("rows"))), F.lit(0))
    agg = tagged.agg(total(0).alias("trips_all_rows"), total(1).alias("obt_rows"))
    return agg.withColumn("counts_match", F.col("trips_all_rows") == F.col("obt_rows"))

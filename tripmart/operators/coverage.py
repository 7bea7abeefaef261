"""Month coverage and the missing-only load plan.

Months are numbered ``year * 12 + month - 1`` so a range is one
``sequence``.  The expected set is generated from a one-row span (no join
with a services table, no cross product), the loaded set is a distinct over
three columns (partial aggregation per task), and both are bounded by
services x months, so the anti join between them is small whatever the size
of the trips table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import month2
from ..functions.names import SERVICES

KEYS = ["service_type", "year", "month"]


def month_index(year, month) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    return y.cast("int") * 12 + m.cast("int") - 1


def _from_index(idx: Column) -> list[Column]:
    return [F.floor(idx / 12).cast("int").alias("year"),
            (F.pmod(idx, F.lit(12)) + 1).cast("int").alias("month")]


def _expand(span: DataFrame, services) -> DataFrame:
    """span: one row with ``lo``/``hi`` month indexes -> service x month rows."""
    svc = F.array(*[F.lit(s) for s in services])
    return (span.select(F.explode(svc).alias("service_type"), "lo", "hi")
            .select("service_type", F.explode(F.sequence("lo", "hi")).alias("_idx"))
            .select("service_type", *_from_index(F.col("_idx"))))


def expected_months(spark: SparkSession, start: tuple[int, int], end: tuple[int, int],
                    services=SERVICES) -> DataFrame:
    """Every (service, year, month) from ``start`` to ``end`` inclusive.

    ``end=(2025, 8)`` gives the source's plan with the last year cut at 08.
    """
    lo, hi = start[0] * 12 + start[1] - 1, end[0] * 12 + end[1] - 1
    span = spark.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    return _expand(span, services)


def expected_by_year(spark: SparkSession, months: dict[int, list[int]], services=SERVICES) -> DataFrame:
    """L2: a plan that names the months of each year, e.g. ``{2024: range(1, 13), 2025: [1, 2]}``;
    years without months plan nothing."""
    rows = [(s, int(y), int(m)) for s in services for y, ms in sorted(months.items()) for m in sorted(set(ms))]
    return spark.createDataFrame(rows, "service_type string, year int, month int")


def expected_full_years(loaded: DataFrame, services=SERVICES) -> DataFrame:
    """Expected months = whole calendar years spanned by the loaded months."""
    span = loaded.agg((F.min("year") * 12).alias("lo"), (F.max("year") * 12 + 11).alias("hi"))
    return _expand(span, services)


def loaded_months(trips: DataFrame) -> DataFrame:
    """Distinct (service, year, month) present in a trips table."""
    return trips.select(*KEYS).distinct()


def missing_months(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """Expected minus loaded, sorted."""
    return (expected.join(loaded, KEYS, "left_anti")
            .orderBy(*[F.col(k).asc_nulls_last() for k in KEYS]))


def missing_by_year(missing: DataFrame) -> DataFrame:
    """Per service and year, the missing months as '02, 04' and their count.

    A group holds at most 12 months, so collecting it is bounded.
    """
    return (missing.groupBy("service_type", "year")
            .agg(F.array_join(F.sort_array(F.collect_list(month2("month"))), ", ")
                  .alias("missing_months"),
                 F.count(F.lit(1)).alias("n_missing"))
            .orderBy(F.col("service_type").asc_nulls_last(), F.col("year").asc_nulls_last()))


def load_plan(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """L3: the months still to load, as a plan DataFrame for ``ingest.run``."""
    return missing_months(expected, loaded)

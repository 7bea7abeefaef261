"""Dimensions: zone lookup (S2, P6, T5) and code tables.

Dimensions are joined to trips with broadcast hash joins, but only behind a
checked size bound: the zone table comes from a file whose size is not known
in advance, so its row count is checked once (on at most ``max_rows + 1``
rows) before it is broadcast.  Above the bound the join is left to the
planner (sort-merge, or AQE's runtime broadcast).  The same check tells
whether the key is unique, which is what makes it safe to skip a join whose
columns a report does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code dimensions (key, description) as the source defines them.
PAYMENT_TYPES = [(1, "Credit card"), (2, "Cash"), (3, "No charge"), (4, "Dispute"),
                 (5, "Unknown"), (6, "Voided")]
RATE_CODES = [(1, "Standard rate"), (2, "JFK"), (3, "Newark"), (4, "Nassau/Westchester"),
              (5, "Negotiated fare"), (6, "Group ride")]
VENDORS = [(1, "Creative Mobile Technologies (CMT)"), (2, "VeriFone (VTS)")]

CODE_DIMS = {
    "payment": ("payment_type", "payment_type_desc", PAYMENT_TYPES),
    "vendor": ("vendor_id", "vendor_name", VENDORS),
    "rate": ("rate_code_id", "rate_code_desc", RATE_CODES),
}

ZONE_CSV_SCHEMA = T.StructType([
    T.StructField("LocationID", T.StringType()),
    T.StructField("Borough", T.StringType()),
    T.StructField("Zone", T.StringType()),
    T.StructField("service_zone", T.StringType()),
])

# A zone lookup has a few hundred rows and a code table a handful; anything
# beyond these bounds, in rows or in bytes, is not broadcast.
ZONE_BROADCAST_MAX_ROWS = 100_000
CODE_BROADCAST_MAX_ROWS = 10_000
BROADCAST_MAX_BYTES = 32 << 20


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_relation(spark: SparkSession, rows: list[tuple[int, str]],
                    names: tuple[str, str]) -> DataFrame:
    """``SELECT * FROM VALUES (..), (..) AS T(a, b)``."""
    body = ", ".join(f"({int(k)}, {_sql_str(v)})" for k, v in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS T({names[0]}, {names[1]})")


def code_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Payment, vendor and rate-code dimensions (2-6 rows each)."""
    return {k: values_relation(spark, rows, (key, desc))
            for k, (key, desc, rows) in CODE_DIMS.items()}


def clean_zones(raw: DataFrame) -> DataFrame:
    """Trim, cast and rename the four lookup columns."""
    return raw.select(
        F.trim(F.col("LocationID")).try_cast("int").alias("LOCATIONID"),
        F.trim(F.col("Borough")).cast("string").alias("BOROUGH"),
        F.trim(F.col("Zone")).cast("string").alias("ZONE"),
        F.trim(F.col("service_zone")).cast("string").alias("SERVICE_ZONE"),
    )


def read_zones_csv(spark: SparkSession, path: str) -> DataFrame:
    """S2 + P6: the zone lookup CSV (header, all strings, no inference)."""
    raw = spark.read.option("header", True).schema(ZONE_CSV_SCHEMA).csv(path)
    return clean_zones(raw)


@dataclass(frozen=True)
class Dims:
    zones: DataFrame
    codes: dict[str, DataFrame]
    zones_small: bool
    zones_unique: bool
    codes_small: bool = True        # inline VALUES: bounded and unique by construction
    codes_unique: bool = True


def check_bound(df: DataFrame, key: str, max_rows: int) -> tuple[bool, bool]:
    """(at most ``max_rows`` rows of BROADCAST_MAX_BYTES, key unique) from one small job over
    <= max_rows+1 rows."""
    size = F.octet_length(F.to_json(F.struct("*")))
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                   F.count_distinct(key).alias("k"),
                                   F.count(key).alias("nn"), F.sum(size).alias("bytes")).first()
    whole = r["n"] <= max_rows
    return whole and (r["bytes"] or 0) <= BROADCAST_MAX_BYTES, whole and r["k"] == r["n"] == r["nn"]


def build_dims(spark: SparkSession, zones: DataFrame,
               max_zone_rows: int = ZONE_BROADCAST_MAX_ROWS,
               codes: dict[str, DataFrame] | None = None) -> Dims:
    """Zones plus code tables, with their size bounds and key uniqueness.

    Without ``codes`` the inline code tables are used (no check needed);
    stored code tables (e.g. from ``read_code_tables``) are checked like zones.
    """
    small, unique = check_bound(zones, "LOCATIONID", max_zone_rows)
    if codes is None:
        return Dims(zones=zones, codes=code_dims(spark), zones_small=small, zones_unique=unique)
    checks = [check_bound(codes[role], key, CODE_BROADCAST_MAX_ROWS)
              for role, (key, _d, _r) in CODE_DIMS.items()]
    return Dims(zones=zones, codes=codes, zones_small=small, zones_unique=unique,
                codes_small=all(c[0] for c in checks), codes_unique=all(c[1] for c in checks))


def code_usage(trips: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Each distinct code per code dimension with its trip count, parsed key
    and description (Q3: text codes such as 'CMT' get no key, no description).

    One scan: trips are counted by the three codes together, and only those
    few rows are unpivoted with ``explode`` and summed per code; the result
    is joined to the code tables.
    """
    from ..functions import code_key
    pairs = F.explode(F.array(*[
        F.struct(F.lit(role).alias("dim"), F.col(key).alias("code"))
        for role, (key, _desc, _rows) in CODE_DIMS.items()]))
    together = trips.groupBy(*[key for key, _desc, _rows in CODE_DIMS.values()]).agg(F.count(F.lit(1)).alias("n"))
    used = (together.select(pairs.alias("p"), "n").groupBy("p.dim", "p.code").agg(F.sum("n").alias("n"))
            .withColumn("code_key", code_key(F.col("code"))))
    long_dims = None
    for role, (key, desc, _rows) in CODE_DIMS.items():
        d = codes[role].select(F.lit(role).alias("dim"), F.col(key).alias("code_key"),
                               F.col(desc).alias("description"))
        long_dims = d if long_dims is None else long_dims.unionByName(d)
    small, _unique = check_bound(long_dims, "code_key", CODE_BROADCAST_MAX_ROWS)
    return (used.join(F.broadcast(long_dims) if small else long_dims, ["dim", "code_key"], "left")
            .select("dim", "code", "code_key", "description", "n")
            .orderBy("dim", F.col("code").asc_nulls_last()))


def write_code_tables(spark: SparkSession, database: str, root: str) -> dict[str, str]:
    """K4: each code dimension made a catalog table by CREATE TABLE AS over its inline VALUES
    (replaced if present); returns {role: name}."""
    from .. import sinks
    names = {}
    for role, (key, desc, rows) in CODE_DIMS.items():
        body = ", ".join(f"({int(k)}, {_sql_str(v)})" for k, v in rows)
        names[role] = f"{database}.{key}_dim"
        sinks.create_table_as(spark, names[role], f"SELECT * FROM VALUES {body} AS T({key}, {desc})",
                              f"{root.rstrip('/')}/{key}_dim")
    return names


def read_code_tables(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    return {role: spark.table(name) for role, name in names.items()}

"""Schema harmonisation.

Each raw month keeps the schema of its file.  A branch is harmonised by
picking, per canonical column, the first raw candidate that exists (or a typed
NULL), casting it the warehouse way and tagging service/year/month.  Months
that share a schema are scanned together, so the union has one branch per
schema signature, not one per month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import CASTS, typed_null
from ..schema import COLUMN_MAP, RAW_TIME_COLUMNS, TRIPS_ALL_COLUMNS


def column_index(schema: T.StructType) -> dict[str, T.StructField]:
    """Upper-cased raw column name -> field (schema metadata, no job)."""
    return {f.name.upper(): f for f in schema.fields}


def pick(cols: dict[str, T.StructField], candidates: list[str], kind: str, alias: str,
         mode: str = "first") -> Column:
    """First existing candidate cast to ``kind``; typed NULL if none exists.

    ``mode="coalesce"`` (P9) coalesces every existing candidate instead, for
    frames that carry several alternates (e.g. after a by-name union).  A
    missing candidate is never named, so a plan never fails on it.
    """
    present = [cols[c.upper()] for c in candidates if c.upper() in cols]
    if not present:
        return typed_null(kind).alias(alias)
    cast = CASTS[kind]
    exprs = [cast(F.col(f"`{f.name}`"), f.dataType) for f in present]
    if mode == "first":
        return exprs[0].alias(alias)
    if mode == "coalesce":
        return (exprs[0] if len(exprs) == 1 else F.coalesce(*exprs)).alias(alias)
    raise ValueError(f"unknown pick mode {mode!r}")


def lossy(schema: T.StructType) -> list[tuple[str, Column, Column]]:
    """(canonical column, raw value, cast value) of the columns whose cast can lose a value of
    ``schema``: text read as a number or a time, and fractions, decimals and floats as integers."""
    cols, out = column_index(schema), []
    for candidates, kind, alias in COLUMN_MAP:
        f = next((cols[c.upper()] for c in candidates if c.upper() in cols), None)
        if f is None or kind == "varchar":
            continue
        if isinstance(f.dataType, T.StringType) or (kind == "number" and isinstance(
                f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))):
            raw = F.col(f"`{f.name}`")
            out.append((alias, raw, CASTS[kind](raw, f.dataType)))
    return out


def is_lost(raw: Column, cast: Column) -> Column:
    return raw.isNotNull() & cast.isNull()


def lost_values(raw: DataFrame, service: str) -> DataFrame:
    """(service_type, file, column, raw) for every value of ``raw`` that its cast loses."""
    found = F.array_compact(F.array(*[
        F.when(is_lost(value, cast), F.struct(F.lit(alias).alias("column"), value.cast("string").alias("raw")))
        for alias, value, cast in lossy(raw.schema)]))
    return (raw.select(F.lit(service).alias("service_type"), F.col("_metadata.file_path").alias("file"),
                       F.explode(found).alias("lost")).select("service_type", "file", "lost.column", "lost.raw"))


def normalize_timestamps(df: DataFrame) -> DataFrame:
    """Cast the raw pickup/dropoff columns that exist to plain timestamps."""
    cols = column_index(df.schema)
    repl = {}
    for c in RAW_TIME_COLUMNS:
        f = cols.get(c.upper())
        if f is not None:
            repl[f.name] = CASTS["timestamp"](F.col(f"`{f.name}`"), f.dataType)
    return df.withColumns(repl) if repl else df


def _as_int(v) -> Column:
    """A year/month tag: a Column, a column name, or a literal like 2019 / '01'."""
    if isinstance(v, Column):
        return v.cast("int")
    if isinstance(v, str) and not v.isdigit():
        return F.col(v).cast("int")
    return F.lit(int(v)).cast("int")


def harmonize(df: DataFrame, service, year, month, mode: str = "first") -> DataFrame:
    """One raw branch -> the 20 canonical columns of the trips table.

    ``service`` is a literal (or a Column for mixed frames); ``year``/``month`` are literals (from a table or
    file name) or Columns (e.g. parsed from ``_metadata.file_path``).
    """
    cols = column_index(df.schema)
    svc = service if isinstance(service, Column) else F.lit(service)
    exprs = [F.lower(svc).cast("string").alias("service_type")]
    exprs += [pick(cols, cand, kind, alias, mode) for cand, kind, alias in COLUMN_MAP]
    exprs += [_as_int(year).alias("year"), _as_int(month).alias("month")]
    return df.select(*exprs)


def union_all(branches: list[DataFrame]) -> DataFrame:
    """UNION ALL of harmonised branches, matched by column name."""
    if not branches:
        raise ValueError("no branches to union")
    out = reduce(lambda a, b: a.unionByName(b), branches)
    return out.select(*TRIPS_ALL_COLUMNS)


def schema_signature(schema: T.StructType) -> str:
    """Key for grouping months whose files can share one scan."""
    return ",".join(f"{f.name.upper()}:{f.dataType.simpleString()}"
                    for f in sorted(schema.fields, key=lambda f: f.name.upper()))

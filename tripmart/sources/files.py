"""Monthly trip files: inventory, one-month scan and the schema-grouped scan.

A month unit is a path whose last component is
``<service>_tripdata_<YYYY>-<MM>[.parquet]``: a single Parquet file (as the
source publishes them) or a folder of part files (as Spark writes them).
The listing is Spark's own file index (parallel for many folders); file
contents are never read for an inventory.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..functions.names import FILE_PATTERN, FILE_UNIT_PATTERN, extract_int, extract_str
from ..sinks.monthly import fs_path
from ..operators.harmonize import (harmonize, is_lost, lossy, normalize_timestamps, schema_signature,
                                   union_all)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_path(spark, path)
    return bool(fs.exists(p))


def month_path(root: str, service: str, year: int, month) -> str:
    return f"{root.rstrip('/')}/{service.lower()}_tripdata_{int(year)}-{int(month):02d}.parquet"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of every Parquet file below ``root``; no content is read."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(root).select("path", "length", "modificationTime"))


def _fingerprint():
    """A grouped digest of files that doesn't depend on their order and changes with any of them."""
    mixed = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return F.sha2(F.concat_ws(":", F.count("path"), F.sum("length"), F.sum(mixed.cast("decimal(38,0)"))), 256)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files that are, or lie below, ``path``."""
    return list_files(spark, path).agg(_fingerprint().alias("f")).first()["f"]


def month_units(spark: SparkSession, root: str) -> DataFrame:
    """One row per correctly named month unit: unit, service_type, year, month, fingerprint."""
    files = list_files(spark, root).withColumn("unit", extract_str("path", FILE_UNIT_PATTERN, 1))
    units = files.where("unit IS NOT NULL").groupBy("unit").agg(_fingerprint().alias("fingerprint"))
    # the name is parsed once a unit, not once a file
    return units.select("unit", F.lower(extract_str("unit", FILE_PATTERN, 1)).alias("service_type"),
                        extract_int("unit", FILE_PATTERN, 2).alias("year"),
                        extract_int("unit", FILE_PATTERN, 3).alias("month"), "fingerprint")


def list_units(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file below ``root`` with its month unit parsed.

    Columns: path, unit, service_type, year, month.  Files outside a
    correctly named unit get NULL keys (callers filter or report them).
    """
    unit = extract_str("path", FILE_UNIT_PATTERN, 1)
    return (list_files(spark, root).drop("length", "modificationTime").withColumn("unit", unit)
            .withColumn("service_type", F.lower(extract_str("unit", FILE_PATTERN, 1)))
            .withColumn("year", extract_int("unit", FILE_PATTERN, 2))
            .withColumn("month", extract_int("unit", FILE_PATTERN, 3)))


def inventory_files(units: DataFrame) -> DataFrame:
    """Number of month units per (service, year, month).

    A month published twice (e.g. in two folders) counts 2.
    """
    return (units.where(F.col("unit").isNotNull())
            .groupBy("service_type", "year", "month")
            .agg(F.count_distinct("unit").alias("n_files"))
            .orderBy("service_type", "year", "month"))


def load_month(spark: SparkSession, root: str, service: str, year: int, month,
               sample: int | None = None) -> DataFrame | None:
    """One raw month with normalised timestamps; None if it is absent.

    ``sample`` keeps only that many rows (0 gives none, None all of them), for smoke tests: those
    with the smallest digests, so the sample is the same however the month is laid out in files.
    Every task keeps its own smallest; no more than ``sample`` rows a task are compared at the end.
    """
    path = month_path(root, service, year, month)
    if not exists(spark, path):
        return None
    df = spark.read.option("mergeSchema", "true").parquet(path)
    df = normalize_timestamps(df)
    return df if sample is None else sample_rows(df, sample)


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """V4: the ``n`` rows with the smallest digests of their columns' text; equal digests are equal
    rows, as far as text shows them."""
    def text(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType):      # to the microsecond, always six digits
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c * 1_000_000).cast("decimal(38,0)")
        return F.coalesce(c.cast("string"), F.lit(""))
    return df.orderBy(F.md5(F.concat_ws("|", *[text(f) for f in df.schema]))).limit(n)


def _inferred(spark: SparkSession, paths: list[str], threads: int) -> dict:
    """{path: merged schema of its footers | Exception}; metadata only, read concurrently."""
    def one(p):
        try:
            return p, spark.read.option("mergeSchema", "true").parquet(p).schema
        except Exception as e:  # noqa: BLE001 - reported per month
            return p, e
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(paths)))) as ex:
        return dict(ex.map(one, paths))


def unit_scans(spark: SparkSession, units: list[str], threads: int = 16) -> dict:
    """What to read of each unit: {unit: [(path, schema)] | Exception}.

    A unit whose parts' types merge is one path with the merged schema.  One whose parts give a
    column types that don't merge is split: each of its files is read with its own schema.  A unit
    with a file that can't be read is an error, which doesn't stop the rest.
    """
    out = {}
    for unit, got in _inferred(spark, units, threads).items():
        if not isinstance(got, Exception):
            out[unit] = [(unit, got)]
            continue
        try:
            paths = [r["path"] for r in list_files(spark, unit).select("path").collect()]
            parts = _inferred(spark, paths, threads) if len(paths) > 1 else {}
        except Exception:  # noqa: BLE001 - the unit's own error is reported
            parts = {}
        bad = [e for e in parts.values() if isinstance(e, Exception)]
        out[unit] = (bad or [got])[0] if bad or not parts else sorted(parts.items())
    return out


def scan_signature(scans: list) -> str:
    """Signature of a unit: those of its scans."""
    return " | ".join(sorted({schema_signature(s) for _, s in scans}))


def read_units(spark: SparkSession, units: list[tuple[str, str]],
               scans: dict, watched: list | None = None) -> DataFrame:
    """Harmonised trips of the given (unit, service) pairs, one scan per
    (service, schema signature); year/month come from each row's file path.

    ``watched`` is filled with (observation, raw rows, service) of the scans whose casts can lose
    values; the observation counts the lost ones of each column in the pass that reads them."""
    groups: dict[tuple[str, str], list] = defaultdict(list)
    for unit, service in units:
        for path, sch in scans[unit]:
            groups[(service, schema_signature(sch))].append((path, sch))
    branches = []
    for (service, _sig), found in sorted(groups.items(), key=lambda g: g[0]):
        # the units' merged schema: a column that the first file lacks is read all the same
        df = spark.read.schema(found[0][1]).parquet(*[path for path, _ in found])
        losses = lossy(df.schema)
        if watched is not None and losses:
            seen = Observation()
            watched.append((seen, df, service))
            df = df.select("*", "_metadata").observe(seen, *[
                F.count_if(is_lost(raw, cast)).alias(name) for name, raw, cast in losses])
        fp = F.col("_metadata.file_path")
        branches.append(harmonize(df, service, extract_int(fp, FILE_PATTERN, 2),
                                  extract_int(fp, FILE_PATTERN, 3)))
    return union_all(branches)


def write_months(df: DataFrame, root: str, service: str, year_col: str, month_col: str,
                 rebalance: bool = True) -> None:
    """Write rows as month units ``<service>_tripdata_<YYYY>-<MM>.parquet/``.

    One job writes a folder per month, which is then given the unit name;
    a month already present under ``root`` is replaced, so landing a month
    twice leaves it once.
    Rows are rebalanced by month first (few files per month; AQE splits a
    month holding a large share of rows); ``rebalance=False`` writes rows
    from the tasks that hold them, for input already one month per task.
    """
    spark = df.sparkSession
    unit = F.concat(F.lit(f"{service.lower()}_tripdata_"), F.col(year_col).cast("string"),
                    F.lit("-"), F.lpad(F.col(month_col).cast("string"), 2, "0"),
                    F.lit(".parquet"))
    root = root.rstrip("/")
    staging = f"{root}.staging-{service.lower()}-{uuid.uuid4().hex[:12]}"
    out = df.withColumn("_unit", unit).drop(year_col, month_col)
    if rebalance:
        out = out.hint("rebalance", "_unit")
    session.write_side_by_side(spark)
    out.write.mode("overwrite").partitionBy("_unit").parquet(staging)
    jvm = spark.sparkContext._jvm
    rp, fs = fs_path(spark, root)
    fs.mkdirs(rp)
    sp, _ = fs_path(spark, staging)
    for st in fs.listStatus(sp):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("_unit="):
            dst = jvm.org.apache.hadoop.fs.Path(rp, name[len("_unit="):])
            old = jvm.org.apache.hadoop.fs.Path(sp, f"old-{name}")
            replaced = fs.exists(dst)           # re-landing a month replaces it
            if replaced and not fs.rename(dst, old):
                raise OSError(f"cannot move {dst} aside")
            if not fs.rename(st.getPath(), dst):
                if replaced:
                    fs.rename(old, dst)
                raise OSError(f"cannot move {st.getPath()} to {dst}")
    fs.delete(sp, True)

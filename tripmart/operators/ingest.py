"""Load job (L1-L3): plan -> harmonised months in a catalog table -> manifest.

The plan is a DataFrame of (service_type, year, month).  All planned months
found under the source root are harmonised and written in one job (one scan
per schema signature) to a folder of their own; the catalog's partitions are
then switched to it.  Rows are counted from the footers of that folder.  A
month whose files cannot be read is isolated: its schema lookup fails on its
own and it is reported with status ``error``; if the job itself fails, its
months are halved until the bad ones stand alone.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .harmonize import lost_values
from ..sinks.monthly import MonthlyTable, Unit
from ..sources import files

KEYS = ["service_type", "year", "month"]


def _split_repeated(rows) -> tuple[list, list]:
    """(units to load, errors).  A month that several units carry is an error that names
    them all: loading one would lose the rows of the others, loading all would repeat copies."""
    by_month: dict[tuple, list] = {}
    for r in rows:
        by_month.setdefault((r["service_type"], r["year"], r["month"]), []).append(r)
    single = [rs[0] for _, rs in sorted(by_month.items()) if len(rs) == 1]
    errors = [(*k, "duplicate: " + ", ".join(sorted(r["unit"] for r in rs)))
              for k, rs in sorted(by_month.items()) if len(rs) > 1]
    return single, errors


def _land(spark, table: MonthlyTable, units: list, scans: dict, workers: int = 4) -> tuple[dict, list]:
    """Land the units; returns ({month: rows}, [(service, year, month, error)]).

    All units are one job.  A job that fails is halved, and the halves run again side by side, so
    one bad month among n costs about 2 log2(n) jobs and the good ones are still loaded.
    """
    rows, errors, todo = {}, [], [units] if units else []

    def stage(batch):
        watched = []
        try:
            load = table.stage(files.read_units(spark, [(u["unit"], u["service_type"]) for u in batch], scans, watched))
            _write_rejects(table, load, watched)
            return load
        except Exception as e:  # noqa: BLE001 - the batch is halved, a single month reported
            return e

    while todo:
        with ThreadPoolExecutor(max_workers=min(workers, len(todo))) as ex:
            staged = list(ex.map(stage, todo))
        halves = []
        for batch, load in zip(todo, staged, strict=True):
            if not isinstance(load, Exception):
                rows |= table.switch(load, {_key(u): Unit(u["unit"], u["fingerprint"], files.scan_signature(scans[u["unit"]]))
                                            for u in batch})
            elif len(batch) == 1:
                errors.append((*_key(batch[0]), f"{type(load).__name__}: {load}"))
            else:
                halves += [batch[:len(batch) // 2], batch[len(batch) // 2:]]
        todo = halves
    return rows, errors


def _write_rejects(table: MonthlyTable, load: str, watched: list) -> None:
    """the values that the load's casts lost go to a side table.  They were counted in the pass
    that wrote the load; only scans that lost any are read again."""
    for seen, raw, service in watched:
        if any(seen.get.values()):
            (lost_values(raw, service).select(F.lit(load).alias("load"), "*")
             .write.mode("append").parquet(f"{table.root}/rejects"))


def rejects(spark: SparkSession, target: str | MonthlyTable) -> DataFrame:
    """(load, service_type, file, column, raw): values of the current months that no cast could keep."""
    table = trips_table(spark, target)
    if not files.exists(spark, f"{table.root}/rejects"):
        return spark.createDataFrame([], REJECTS)
    current = table.current().where("location IS NOT NULL").select("load").distinct()
    return spark.read.schema(REJECTS).parquet(f"{table.root}/rejects").join(current, "load", "left_semi")


def _key(r) -> tuple:
    return r["service_type"], r["year"], r["month"]


def trips_table(spark: SparkSession, target: str | MonthlyTable) -> MonthlyTable:
    return target if isinstance(target, MonthlyTable) else MonthlyTable(spark, target)


REJECTS = "load string, service_type string, file string, column string, raw string"
MANIFEST = "service_type string, year int, month int, rows_loaded long, status string, error string"


def run(spark: SparkSession, plan: DataFrame, source_root: str, target: str | MonthlyTable) -> DataFrame:
    """Load the planned months and return the manifest.

    ``target`` is a ``MonthlyTable`` or the root of one.  Manifest columns: service_type, year,
    month, rows_loaded, status ('loaded' | 'missing' | 'error'), error.  A failed month counts 0
    rows, whatever older copy the target keeps; an empty one is loaded with 0, and leaves the table.
    Rows are counted from the footers of what was written.
    """
    # The plan's keys are bounded (services x months) and are read before the target
    # changes: the plan may have been made from it.
    keys = sorted({tuple(r) for r in plan.select(*KEYS).distinct().collect()})
    plan = spark.createDataFrame(keys, "service_type string, year int, month int")
    # The planned units are metadata (one row per month file), bounded by the
    # plan, so they are brought to the driver to plan the scans.
    todo, repeated = _split_repeated(files.month_units(spark, source_root).join(plan, KEYS, "left_semi").collect())
    scans = files.unit_scans(spark, [r["unit"] for r in todo])
    bad = [(*_key(r), f"{type(scans[r['unit']]).__name__}: {scans[r['unit']]}")
           for r in todo if isinstance(scans[r["unit"]], Exception)]
    good = [r for r in todo if not isinstance(scans[r["unit"]], Exception)]
    rows, failed = _land(spark, trips_table(spark, target), good, scans)
    errors = {e[:3]: e[3] for e in bad + repeated + failed}
    return spark.createDataFrame(
        [(*k, rows.get(k, 0), "error" if k in errors else "loaded" if k in rows else "missing", errors.get(k)) for k in keys],
        MANIFEST)


def load_current(spark: SparkSession, source_root: str, target: str | MonthlyTable) -> DataFrame:
    """L3: load the units that are new or whose files changed since they were landed (by name, size
    and time, as the ledger has them) and return their manifest.  Other units are not opened.  A
    month whose unit is gone from ``source_root`` stays in the table; one that failed is tried again.
    """
    landed = trips_table(spark, target).current().select(*KEYS, F.col("fingerprint").alias("_landed"))
    units = files.month_units(spark, source_root).join(landed, KEYS, "left")
    return run(spark, units.where(~F.col("fingerprint").eqNullSafe(F.col("_landed"))), source_root, target)


def load_missing(spark: SparkSession, source_root: str, target: str | MonthlyTable,
                 start: tuple[int, int], end: tuple[int, int],
                 services=("yellow", "green")) -> DataFrame:
    """L3 end to end: expected months minus the months already in ``target``
    form the plan, and only those are loaded.  Returns the manifest of this
    run (empty when nothing is missing)."""
    from . import coverage
    expected = coverage.expected_months(spark, start, end, services)
    table = trips_table(spark, target)
    plan = coverage.load_plan(expected, table.months()) if table.has_ledger() else expected
    return run(spark, plan, source_root, table)

"""The view stack over one data directory.

``Mart`` wires sources -> harmonised trips -> OBT -> clean / strict ->
enriched, like the chain of warehouse views.  One step is stored: the
harmonised trips are a catalog table of months (the counterpart of the
warehouse's loaded tables) in the shared scratch folder, kept current from
its ledger: a service is landed again only when its source files changed,
and another application finds the table as it is.  Everything above it stays
lazy, so each report is one Catalyst plan from that table to its result.
"""

from __future__ import annotations

import hashlib
import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import schema, session, sinks
from ..functions import casts
from ..operators import dims as dims_mod
from ..operators import harmonize, marts
from ..operators.rollup import Rollup
from ..schema import TRIPS_ALL_COLUMNS
from ..sinks.monthly import MonthlyTable, Unit, code_digest
from ..sources import catalog, files, testdata


# Folders already written in this application, by source.
_TABLES: dict[tuple, str] = {}
_DIMS: dict[tuple, "dims_mod.Dims"] = {}
# Trips tables that are current, with the sources they were made from.
_CURRENT: dict[tuple, dict] = {}
_LOCK = threading.RLock()


#: Signature of landed services: another once the code that makes the harmonised rows is changed, so
#: tables kept by an earlier version of the package are landed again.
RULES = code_digest(testdata, harmonize, casts, schema)


def _stamp(spark: SparkSession, path: str) -> str:
    """Identity of a source table: size and time of a file, or those of all files of a folder."""
    p, fs = files.fs_path(spark, path)
    st = fs.getFileStatus(p)
    return files.fingerprint(spark, path) if st.isDirectory() else f"{st.getLen()}:{st.getModificationTime()}"


def _source_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    return tuple((name, _stamp(spark, f"{sf_dir}/{name}.parquet")) for name in ("lineitem", "events", "nation", "region"))


class Mart:
    """The view stack over the driver's tables in ``sf_dir``.

    ``trips_table`` is the root of an existing trips table (as written by
    ``ingest.run``); without it, one is kept for the source.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, trips_table: str | None = None):
        self.spark = session.configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.trips_table = trips_table

    @cached_property
    def raw_services(self) -> list[testdata.RawMonths]:
        return testdata.services(self.spark, self.sf_dir)

    def raw(self, service: str) -> testdata.RawMonths:
        return next(r for r in self.raw_services if r.service == service)

    def harmonized(self, service: str) -> DataFrame:
        r = self.raw(service)
        return harmonize.harmonize(r.df, r.service, testdata.FILE_YEAR, testdata.FILE_MONTH)

    @cached_property
    def trips_union(self) -> DataFrame:
        """T1 as a lazy plan: the harmonised branches, unioned."""
        return harmonize.union_all([self.harmonized(r.service) for r in self.raw_services])

    def _built_once(self, kind: str, build) -> str:
        """Path of a table derived from this source, written once per
        application under the shared scratch folder and reused."""
        key = (kind, self.spark.sparkContext.applicationId, self.sf_dir,
               _source_stamp(self.spark, self.sf_dir))
        with _LOCK:
            path = _TABLES.get(key)
            # an entry is recorded only after its write job committed
            if path is None or not files.exists(self.spark, path):
                path = session.scratch_dir(self.spark, kind)
                build(path)
                _TABLES[key] = path
        return path

    @property
    def _home(self) -> str:
        """Folder of what is kept for this source, the same in every application."""
        return f"{session.scratch_root(self.spark).rstrip('/')}/tripmart/mart-{self._hash}"

    @property
    def _hash(self) -> str:
        return hashlib.md5(self.sf_dir.encode()).hexdigest()[:12]

    @cached_property
    def database(self) -> str:
        """Catalog database of this source's tables."""
        return sinks.create_database(self.spark, f"mart_{self._hash}", f"{self._home}/db")

    @cached_property
    def table(self) -> MonthlyTable:
        """The catalog table TRIPS_ALL, current with its source: services whose source changed since
        they were landed are landed again, in one job; nothing is written otherwise."""
        if self.trips_table:
            return MonthlyTable(self.spark, self.trips_table)
        table = MonthlyTable(self.spark, f"{self._home}/trips_all", f"{self.database}.TRIPS_ALL")
        paths = {r.service: f"{self.sf_dir}/{r.table}.parquet" for r in self.raw_services}
        source = {s: Unit(p, _stamp(self.spark, p), RULES) for s, p in paths.items()}
        with _LOCK:
            if _CURRENT.get((self.spark.sparkContext.applicationId, table.name)) == source:
                return table                    # this application has seen to it
            held = {}
            for r in table.current().select("service_type", "year", "month", "unit", "fingerprint", "signature").collect():
                held.setdefault(r["service_type"], {})[tuple(r)[:3]] = Unit(*tuple(r)[3:])
            stale = [s for s, unit in source.items() if set(held.get(s, {}).values()) != {unit}]
            if stale:
                old = {m: source[s] for s in stale for m in held.get(s, {})}
                table.land(harmonize.union_all([self.harmonized(s) for s in stale]), old, rebalance=True,
                           unit_of=lambda month: source[month[0]])
            table.open()
            _CURRENT[self.spark.sparkContext.applicationId, table.name] = source
        return table

    @cached_property
    def trips_all(self) -> DataFrame:
        """The unified trips as every report reads them: a scan of the
        catalog table (column pruning, Parquet filter pushdown and
        partition pruning on service/year/month)."""
        if self.trips_table:
            return sinks.read_trips(self.spark, self.trips_table)
        return self.spark.table(self.table.name).select(*TRIPS_ALL_COLUMNS)

    @cached_property
    def rollup(self) -> Rollup:
        """The roll-up of the trips table, with the months made again that were landed since."""
        table = self.table
        roll = Rollup(table)
        key = (self.spark.sparkContext.applicationId, f"{table.name}-rollup")
        source = _CURRENT.get((self.spark.sparkContext.applicationId, table.name))
        with _LOCK:
            if source is None or _CURRENT.get(key) != source:
                roll.refresh()
                for made in roll.tables.values():
                    made.open()
                _CURRENT[key] = source
        return roll

    @cached_property
    def obt(self) -> DataFrame:
        return marts.obt(self.trips_all)

    @cached_property
    def clean(self) -> DataFrame:
        return marts.clean(self.obt)

    @cached_property
    def strict(self) -> DataFrame:
        return marts.strict(self.trips_all)

    @cached_property
    def zones(self) -> DataFrame:
        return dims_mod.clean_zones(testdata.zone_lookup(self.spark, self.sf_dir))

    @cached_property
    def dims(self) -> dims_mod.Dims:
        """Zone and code dimensions; the zone bound/uniqueness check runs once
        per source and application."""
        key = ("zone-check", self.spark.sparkContext.applicationId, self.sf_dir,
               _source_stamp(self.spark, self.sf_dir))
        with _LOCK:
            d = _DIMS.get(key)
            if d is None:
                d = _DIMS[key] = dims_mod.build_dims(self.spark, self.zones)
        return d

    def enriched(self, roles=marts.ALL_ROLES) -> DataFrame:
        return marts.enrich(self.strict, self.dims, roles)

    @cached_property
    def raw_files_root(self) -> str:
        """The raw services written as monthly files (one folder per month,
        older yellow months in their older schema); read-only for callers."""
        def build(root):
            for r in self.raw_services:
                for era in testdata.file_eras(r):
                    files.write_months(era, root, r.service, testdata.FILE_YEAR,
                                       testdata.FILE_MONTH)
        return self._built_once("raw-months", build)

    @cached_property
    def raw_database(self) -> str:
        """Database of the raw months, each a table over its files, with a ``_TINY`` sample view beside
        every green month and a view ``TRIPS_ALL``; made once per source and application."""
        name = f"raw_{self._hash}"

        def build(path):
            self.spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
            sinks.create_database(self.spark, name, f"{path}/db")
            units = files.month_units(self.spark, self.raw_files_root).collect()     # one row a month
            scans = files.unit_scans(self.spark, [u["unit"] for u in units])
            for table in catalog.register_months(self.spark, name, units, scans):
                if "_GREEN_" in table:
                    self.spark.sql(f"CREATE VIEW {table}_TINY AS SELECT * FROM {table} LIMIT 10")
            self.spark.sql(f"CREATE VIEW {name}.TRIPS_ALL AS SELECT * FROM {self.table.open().name}")
        self._built_once("raw-catalog", build)
        return name

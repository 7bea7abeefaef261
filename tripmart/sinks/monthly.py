"""Monthly catalog tables: a month is switched, never rewritten in place (K1).

A ``MonthlyTable`` is an external catalog table partitioned by service, year and month.  A load
writes a folder of its own, ``<root>/loads/load=<id>/service_type=/year=/month=``, records what it
landed in the ledger, and only then points the catalog's partitions to it, one ``ALTER TABLE ...
PARTITION ... SET LOCATION`` a month.  So

* a load that fails before its ledger rows are written leaves every month as it was;
* a reader sees a month either before or after the load, never a mixture or nothing;
* two writers use different folders; of two loads of one month, the later ledger row wins.

The ledger (``<root>/ledger``, Parquet, appended) has one row for each landed month: its unit, the
unit's fingerprint and schema signature, rows and folder.  It says which units are new or changed,
and a session whose catalog doesn't know the table, or knows an older state, is brought up to date
from it.  Row counts come from the Parquet footers of the new folder, without a scan.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..schema import PARTITION_COLUMNS, TRIPS_ALL_SCHEMA

# Bound on rows per output file, so a huge month yields many files.
MAX_RECORDS_PER_FILE = 5_000_000
KEYS = PARTITION_COLUMNS
LEDGER = ("seq long, load string, service_type string, year int, month int, unit string, fingerprint string, "
          "signature string, rows long, location string")
Month = tuple[str, int, int]
#: (application, table) -> month -> location that this application has set in the catalog.
_APPLIED: dict[tuple, dict[Month, str]] = {}


@dataclass(frozen=True)
class Unit:
    """Where a month comes from; ``fingerprint`` changes when its files do."""
    name: str | None = None
    fingerprint: str | None = None
    signature: str | None = None


def month_filter(months: Iterable[Month]) -> Column:
    """An exact predicate on the partition columns; Spark prunes partitions by it."""
    by_key: dict[tuple, set] = {}
    for service, year, month in months:
        by_key.setdefault((service, int(year)), set()).add(int(month))
    cond = F.lit(False)
    for (service, year), ms in sorted(by_key.items()):
        cond = cond | ((F.col("service_type") == service) & (F.col("year") == year) & F.col("month").isin(sorted(ms)))
    return cond


def code_digest(*modules) -> str:
    """Digest of the source text of modules: what was made by other code isn't taken for current."""
    return hashlib.md5("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()[:16]


def quote(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fs_path(spark: SparkSession, path: str):
    """(Hadoop Path, FileSystem) for a path on any file system Spark can use."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def footer_session(spark: SparkSession) -> SparkSession:
    """A session on the same context whose Parquet scans push aggregates down: COUNT, MIN and MAX
    come from the footers.  The caller's own settings are left alone."""
    other = spark.newSession()
    kept = spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
    other.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in kept if x != "parquet"))
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    other.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return other


class MonthlyTable:
    """A table of months under ``root``, known to the catalog as ``name``."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, schema: T.StructType = TRIPS_ALL_SCHEMA):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.name = name or "monthly_" + hashlib.md5(self.root.encode()).hexdigest()[:16]

    # ------------------------------------------------------------ ledger

    @property
    def ledger_path(self) -> str:
        return f"{self.root}/ledger"

    def _exists(self, path: str) -> bool:
        p, fs = fs_path(self.spark, path)
        return bool(fs.exists(p))

    def has_plain_months(self) -> bool:
        """Whether ``root`` is a folder partitioned by service, as a plain write leaves it."""
        p, fs = fs_path(self.spark, self.root)
        return bool(fs.exists(p)) and any(st.getPath().getName().startswith("service_type=") for st in fs.listStatus(p))

    def has_ledger(self) -> bool:
        return self._exists(self.ledger_path)

    def ledger(self) -> DataFrame:
        """Every landing, oldest included."""
        if not self.has_ledger():
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.ledger_path)

    def current(self) -> DataFrame:
        """The last landing of each month (emptied months included, without a location)."""
        last = self.ledger().groupBy(*KEYS).agg(F.max(F.struct("seq", "load", "unit", "fingerprint", "signature", "rows",
                                                               "location")).alias("last"))
        return last.select(*KEYS, "last.*")

    def _commit(self, rows: list[tuple]) -> None:
        """Append ledger rows: one file, which appears as a whole when the job commits."""
        (self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(self.ledger_path))

    # ------------------------------------------------------------ catalog

    def _create(self) -> None:
        data = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({data}) USING parquet "
                       f"PARTITIONED BY ({', '.join(KEYS)}) LOCATION {quote(self.root + '/loads')}")

    def _stamp(self) -> str | None:
        if not self.spark.catalog.tableExists(self.name):
            self._create()
            _APPLIED.pop(self._key, None)
            return None
        got = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").where("key = 'ledger.state'").first()
        return got["value"] if got else None

    @property
    def _key(self) -> tuple:
        return self.spark.sparkContext.applicationId, self.name

    def _partitions(self) -> set[Month]:
        """The months in the catalog (bounded: services x months)."""
        out = set()
        for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            v = dict(x.split("=", 1) for x in r["partition"].split("/"))
            out.add((unquote(v["service_type"]), int(v["year"]), int(v["month"])))
        return out

    def open(self) -> MonthlyTable:
        """Bring the catalog to the state of the ledger; nothing is done if it is there."""
        rows = self.current().select(*KEYS, "location").collect()       # one row a month
        state = {(r[0], r[1], r[2]): r[3] for r in rows if r[3] is not None}
        stamp = hashlib.md5(repr(sorted(state.items())).encode()).hexdigest()
        if self._stamp() == stamp:
            return self
        have, known = self._partitions(), _APPLIED.get(self._key, {})
        for month in sorted(have - set(state)):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({self._spec(month)})")
        new = sorted(set(state) - have)
        for i in range(0, len(new), 100):
            parts = " ".join(f"PARTITION ({self._spec(m)}) LOCATION {quote(state[m])}" for m in new[i:i + 100])
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {parts}")
        for month in sorted(have & set(state)):
            if known.get(month) != state[month]:
                self.spark.sql(f"ALTER TABLE {self.name} PARTITION ({self._spec(month)}) SET LOCATION {quote(state[month])}")
        _APPLIED[self._key] = state
        self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('ledger.state' = '{stamp}')")
        return self

    @staticmethod
    def _spec(month: Month) -> str:
        return f"service_type = {quote(month[0])}, year = {int(month[1])}, month = {int(month[2])}"

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        """The table by its name; filters on service, year and month prune partitions in the catalog."""
        return self.open().spark.table(self.name).select(*[f.name for f in self.schema.fields])

    def months(self) -> DataFrame:
        """(service_type, year, month) in the catalog; no folder is listed, no file opened."""
        return self.spark.createDataFrame(sorted(self.open()._partitions()), "service_type string, year int, month int")

    def counts(self) -> DataFrame:
        """A1: rows of each month, summed from the Parquet footers of the current folders."""
        folders = [r["location"] for r in self.current().where("location IS NOT NULL").select("location").collect()]
        return self._footer_counts(folders)

    def _footer_counts(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "service_type string, year int, month int, rows long")
        keys = T.StructType([T.StructField("load", T.StringType()), *[f for f in self.schema.fields if f.name in KEYS]])
        files = (footer_session(self.spark).read.schema(keys).option("basePath", f"{self.root}/loads").parquet(*folders))
        # grouped by all partition columns, as the push-down asks for
        part = files.groupBy("load", *KEYS).agg(F.count(F.lit(1)).alias("rows"))
        return part.groupBy(*KEYS).agg(F.sum("rows").alias("rows"))

    # ------------------------------------------------------------ landing

    def stage(self, df: DataFrame, rebalance: bool = False) -> str:
        """Write ``df`` to a folder of its own; readers don't see it.  Returns the load's id.

        ``rebalance`` is for input that is not one month per task: rows are shuffled by month, and
        AQE splits a month that holds a large share of all rows over several tasks.
        """
        if not self.has_ledger() and self.has_plain_months():
            raise ValueError(f"{self.root} holds a plain partitioned table; land its rows under a new root")
        load = uuid.uuid4().hex
        out = df.select(*[f.name for f in self.schema.fields])
        if rebalance:
            out = out.hint("rebalance", *KEYS)
        session.write_side_by_side(self.spark)
        (out.write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .partitionBy(*KEYS).parquet(f"{self.root}/loads/load={load}"))
        return load

    def switch(self, load: str, months: dict[Month, Unit] | None = None,
               unit_of: Callable[[Month], Unit] = lambda month: Unit()) -> dict[Month, int]:
        """Make a staged load the current one of its months and return their rows.

        ``months`` names what the load was to bring: a month in it without rows is emptied, and its
        unit goes to the ledger; ``unit_of`` names the unit of any other month with rows."""
        folder = f"{self.root}/loads/load={load}"
        rows = {(r[0], r[1], r[2]): r[3] for r in self._footer_counts([folder]).select(*KEYS, "rows").collect()}
        units = {m: unit_of(m) for m in rows} | (months or {})
        seq = (self.ledger().agg(F.max("seq")).first()[0] or 0) + 1
        self._commit([(seq, load, *m, u.name, u.fingerprint, u.signature, rows.get(m, 0),
                       f"{folder}/service_type={_escaped(m[0])}/year={m[1]}/month={m[2]}" if m in rows else None)
                      for m, u in sorted(units.items(), key=lambda x: x[0])])
        self.open()
        return {m: rows.get(m, 0) for m in units}

    def land(self, df: DataFrame, months: dict[Month, Unit] | None = None, rebalance: bool = False,
             unit_of: Callable[[Month], Unit] = lambda month: Unit()) -> dict[Month, int]:
        """K1: stage and switch.  Months that neither ``df`` nor ``months`` names stay as they are."""
        return self.switch(self.stage(df, rebalance), months, unit_of)

    def empty(self, months: Iterable[Month]) -> None:
        """Take months out of the table."""
        seq = (self.ledger().agg(F.max("seq")).first()[0] or 0) + 1
        self._commit([(seq, uuid.uuid4().hex, *m, None, None, None, 0, None) for m in months])
        self.open()

    def vacuum(self) -> list[str]:
        """Delete the folders of loads that no month refers to any more; returns their ids.  Not to
        be run while another load is between ``stage`` and ``switch``, or old months are being read."""
        if not self._exists(f"{self.root}/loads"):
            return []
        used = {r["load"] for r in self.current().where("location IS NOT NULL").select("load").distinct().collect()}
        p, fs = fs_path(self.spark, f"{self.root}/loads")
        gone = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("load=") and name[len("load="):] not in used and fs.delete(st.getPath(), True):
                gone.append(name[len("load="):])
        return sorted(gone)


def _escaped(value: str) -> str:
    """A partition value as Spark writes it in a path: special characters as %XX."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{}[]^\x7f" or ord(c) < 32 else c for c in value)

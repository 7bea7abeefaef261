"""Session settings and the shared scratch location.

The library needs only two things from a session: a fixed time zone for the
rare casts between zoned and zone-less timestamps, and a shared folder for
intermediate tables.  Both are read from the session and only filled in where
unset, so a cluster's own settings always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a tripmart job expects.  Shuffle partitions are left to the
# caller: AQE coalesces small ones and splits skewed ones at runtime.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings for a large cluster (100 TB of trips, ~1000 executors), passed as
# ``build_session(extra=CLUSTER_CONF)`` or in spark-defaults:
# * scans: 256 MB splits; trip rows are narrow, so bigger splits mean fewer
#   tasks and fewer Parquet footers per task;
# * shuffles: reports shuffle only partial aggregates, so a generous initial
#   partition count costs nothing once AQE coalesces it; the one large shuffle
#   (a rebalanced write of input that is not month-aligned) targets 256 MB
#   files, and AQE splits a month that holds a large share of rows;
# * coalescing honours the advisory size instead of maximising parallelism.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "tripmart",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the tripmart defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the one runtime setting tripmart relies on: the zone in which the driver's zone-less
    event times are made zoned raw times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Partitions (months) that a task writes side by side.  A file that is open holds its columns' pages
#: in memory, so their number is bounded; rows of any further month are sorted by month as before.
OPEN_PARTITIONS = 256


def write_side_by_side(spark: SparkSession) -> None:
    """Have partitioned writes keep a file open for each partition that a task meets instead of sorting
    all its rows by partition, which spills them once a task's rows are more than its memory.  A
    setting of the caller's own is left alone."""
    if spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) is None:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_PARTITIONS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or the context's checkpoint
    dir) when set.  Only where nothing is set and the master is local, as in tests,
    a folder is made and registered as the checkpoint dir; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tripmart-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared scratch root."""
    root = scratch_root(spark).rstrip("/")
    return f"{root}/tripmart/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that also runs outside Spark."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)

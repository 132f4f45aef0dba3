"""Spark session construction and shared-storage helpers.

Everything scale-related is configured here once: AQE (runtime re-planning,
partition coalescing, skew-join splitting), a UTC session zone (the test
parquet is timestamp_ntz), and the UI off.  Shared storage for lineage cuts
and written intermediates comes from ``spark.checkpoint.dir``; a folder of
our own is made only on a local master, where driver and executors are one
process.  On any other master an unset folder is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # F-9: no `SELECT ... FROM parquet.`/path` reads through the SQL surface.
    "spark.sql.runSQLOnFiles": "false",
    # checkpoint files of a DataFrame nobody references any more are removed
    # by Spark's cleaner, so the shared folder does not grow per query
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# A query's shuffle files go when it ends.  They serve its retries; later
# queries read written tables and checkpoints, so over a long job the shuffle
# files of earlier steps would only fill the executors' disks.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "roomlens") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if master and master.startswith("local["):
        builder = builder.config("roomlens.textPartitions", master[6:-1].replace("*", str(os.cpu_count())))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it.  Unset on a local master: a temporary
    folder, removed when the process ends.  Unset on a cluster: ValueError,
    since a driver-local folder is not visible to executors.  Every operator
    with written steps asks for it, so the session's shuffle cleaning is
    switched on here too."""
    sc = spark.sparkContext
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="roomlens-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside, and the old one after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint dir for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made under :func:`scratch_path`, on whatever file
    system it is; other paths are refused."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"not under the checkpoint folder: {path}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed: the
    folder it was imported from joins their module path.  (On a cluster the
    package is installed or shipped, and an unknown folder does no harm.)"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])

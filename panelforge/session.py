"""Session construction and the shared scratch folder.

Every operator in this package takes and returns DataFrames; the session is
always passed in by the caller.  ``build_session`` exists for tests, the bench
and the examples; on a cluster the platform's session is used as is.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Spark settings the library relies on.  AQE re-plans joins from runtime
# sizes (automatic broadcast of small sides, skew-join splitting, partition
# coalescing); the UI stays off because it opens a port.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Joins on (series, t) between two sides already hash-partitioned by
    # series (the co-located panel and tables derived from it) may reuse
    # that partitioning instead of re-shuffling both sides; every series
    # is bounded by the calendar length, so the co-partition is not skewed.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # checkpoint files go when their DataFrame does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int, input_tb: float = 100.0) -> dict[str, str]:
    """Settings for a large cluster (to pass as ``extra`` or to spark-submit).

    * shuffle partitions: enough that one partition of the largest shuffle
      (taken as about a tenth of the input bytes)
      stays near 256 MB, and at least 3 per core; AQE coalesces small
      shuffles back down, so small stages do not pay for it;
    * 256 MB file splits and advisory partition size, so a task's input and
      its shuffle block fit comfortably in executor memory;
    * skew join: a partition is skewed above 5x the median and 512 MB, and
      AQE splits it.
    """
    largest_shuffle_mb = input_tb * 1024 * 1024 / 10
    parts = max(3 * total_cores, int(largest_shuffle_mb / 256))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "panelforge", driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it to a folder every executor can reach.
    Only when it is unset (local runs, tests) do we pick a fresh local one.
    """
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="panelforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def session_key(spark: SparkSession) -> tuple:
    """Identity of a session for memoized fixtures."""
    return (spark.conf.get("spark.app.id", ""), id(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")

"""Session settings and the shared scratch folder.

Only runtime SQL settings are touched, so the same functions work on a session
handed in by a cluster.  Partition counts are left to the session and AQE.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more exchange: a
    # manager, filing or CUSIP may own a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows are far larger than their Parquet bytes: a cover page takes 8 bytes in the file and over 300 in a
    # broadcast.  By file size alone the planner would build millions of filings on the driver.
    "spark.sql.sources.fileCompressionFactor": "40",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not context.master.startswith("local") and spark.conf.get(INITIAL_PARTITIONS, None) is None:
        # Start shuffles fine and let AQE merge: it can join small partitions, not cut plain ones.
        fine = max(8 * context.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.conf.set(INITIAL_PARTITIONS, str(fine))
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("holdfast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str | None:
    """Folder that every executor can read, or None when there is none.

    The cluster names it in ``spark.checkpoint.dir``.  A machine-local folder is
    used only where the master itself is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        return None
    app = context.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="holdfast-")
    return _scratch[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"

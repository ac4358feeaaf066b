"""Session helpers: a local session for tests and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; a cluster session keeps its own values
# for anything it already sets.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagewright") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset on a ``local[...]`` master (tests) is a fresh
    scratch folder created under /tmp and set on the session; a cluster
    without one is an error, since a machine-local folder would lose the
    checkpoint with its executor.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder on shared storage that every executor can read"
        )
    local = tempfile.mkdtemp(prefix="pagewright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                   max_partition_bytes: int = 256 << 20) -> int:
    """Size shuffle partitions and scan splits for an input of ``input_bytes``.

    Shuffle partitions: enough for ~``target_partition_bytes`` each and at
    least twice the cores (AQE coalesces small ones and splits skewed ones at
    run time, with the same target).  Scan splits: ``max_partition_bytes``.
    Returns the number of shuffle partitions set.
    """
    cores = spark.sparkContext.defaultParallelism
    n = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_partition_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(4 * target_partition_bytes))
    return n

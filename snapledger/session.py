"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Runtime settings only: nothing here needs a restart, so a caller's session can be tuned in place.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# A task that reads reduces its rows per key by sorting them before the shuffle; rows of this much of a compressed file fit its memory.
SPLIT = "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 32 << 20
BOUNDED = "snapledger.bounded"


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def bound_reads(spark: SparkSession) -> None:
    """Bound what a task reads of a file, never above what the session sets."""
    spark.conf.set(SPLIT, str(min(_bytes(spark.conf.get(SPLIT)), SPLIT_BYTES)))
    spark.conf.set(BOUNDED, "true")


def tune(spark: SparkSession) -> SparkSession:
    """Pin the time zone to UTC, switch adaptive execution on and bound what a task reads of a file."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    bound_reads(spark)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str | None = None) -> SparkSession:
    """Session for tests and the local benchmark; ``checkpoints`` is the folder for ``spark.checkpoint.dir``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("snapledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into.

    A cluster names it in ``spark.checkpoint.dir``. A throw-away folder is used only by a local master,
    where driver and executors share the disk; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="snapledger-checkpoint-")
    context.setCheckpointDir(folder)
    return folder

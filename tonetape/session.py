"""Session rules every plan relies on, and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def pin(spark: SparkSession) -> SparkSession:
    """Set the run-time settings the operators assume; safe on a session made elsewhere.

    Every stamp is read and shown in UTC, and writing one day must not wipe the other days.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: int | str = "*", *, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench. On a cluster, use the cluster's own."""
    return pin(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tonetape")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new, unused folder name under ``spark.checkpoint.dir``.

    Only where that is unset and the master is local is a temporary folder of this machine used:
    on a cluster, other executors could not see it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="tonetape-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tonetape-{uuid.uuid4().hex}"

"""Session settings the library is written for."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Partitions that the costly test tables are dealt to after the scan, where it is set: small
# tables come as one file with one row group.  Large tables have splits enough; leave it unset.
INPUT_PARTITIONS = "spark.chatprep.inputPartitions"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "chatprep", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config(INPUT_PARTITIONS, str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, on storage all executors share.

    It lies below ``spark.checkpoint.dir``.  Where that is unset it lies below the warehouse, in a
    local session only: a cluster must name a folder that all its machines share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

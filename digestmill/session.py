"""Session settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that change results or that every operator relies on at scale.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches for Python are bounded by bytes, so that very long texts do not meet by the thousand in one.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "digestmill") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DIGESTMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small tables are one row group each; see plans/bindings.py.
        .config("spark.digestmill.scanTasks", str(shuffle_partitions))
        # Call sites are captured per Column call otherwise, which dominates short queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

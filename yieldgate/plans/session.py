"""Sessions with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster's own session needs no more than SETTINGS."""
    builder = SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', 8)}]").config(map=SETTINGS)
    local = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
    spark = builder.config(map={k: str(v) for k, v in local.items()}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

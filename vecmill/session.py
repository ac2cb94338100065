"""Session defaults used by tests, bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cores: int | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster pass your own instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cores}]").appName("vecmill")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", "6g")
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

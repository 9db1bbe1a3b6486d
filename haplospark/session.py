"""SparkSession builder with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "haplospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time. On a cluster pass no master: spark-submit's own settings win."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app)
    if master or "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(master or f"local[{cores}]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

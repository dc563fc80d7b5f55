"""Local session for tests and the bench. On a cluster, use the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app_name: str, cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

"""Session factory: UTC, adaptive execution, partitions sized for the machine it runs on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "fathom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session whose settings can all be overridden; on a cluster leave master unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""The session the engine expects: UTC, adaptive plans and Arrow transfer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "wakeline", **settings: str) -> SparkSession:
    """A session with the engine's settings; what the cluster sets itself (memory, checkpoint folder) stays."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

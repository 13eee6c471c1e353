"""A session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "offerlens", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; the master and sizes are left to spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()

"""The session that the library expects: UTC, adaptive execution, ANSI semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessella", **settings: str) -> SparkSession:
    """Get or make a session. Partition counts are left to adaptive execution."""
    builder = SparkSession.builder.appName(app)
    plain = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for k, v in (plain | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

"""Session defaults for point-in-time work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC dates; further settings win over these."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()

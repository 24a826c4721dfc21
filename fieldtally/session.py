"""Session settings the operators are designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks broadcast or sort-merge from measured sizes, merges small shuffle
# partitions and splits skewed ones; the operators carry no broadcast hints of their own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also where splitting a skewed join costs one more shuffle for the aggregation behind it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "fieldtally", master: str | None = None, **extra: str) -> SparkSession:
    """Create or fetch a session. ``extra`` keys use ``__`` for dots: ``spark__ui__enabled="false"``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

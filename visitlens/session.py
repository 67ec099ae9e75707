"""Session settings the library is tuned for; a cluster's own values win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The label cascade generates more code than the JVM compiles in one method; beyond this size
    # Spark evaluates it in smaller pieces, which is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Plans are assembled from many small expressions; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(name: str = "visitlens", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Per-address activity used by the rate rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.metrics import active_seconds
from visitlens.operators.filters import since
from visitlens.operators.skew import spread_join


def session_stats(df: DataFrame, hours: float | None = None, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Request count and first-to-last seconds per address, optionally of recent hours only."""
    if hours is not None:
        df = since(df, hours, as_of)
    return df.groupBy("client_ip").agg(
        F.count(F.lit(1)).alias("request_count"),
        active_seconds().alias("span_seconds"),
    )


def with_session_stats(events: DataFrame, hours: float | None = None, as_of=None) -> DataFrame:
    """Events with the statistics of their address, ready for the rate rules."""
    stats = session_stats(events, hours, as_of).withColumn("_rows", F.col("request_count"))
    return spread_join(events, stats, "client_ip", "_rows", "left")

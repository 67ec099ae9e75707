"""Aggregates that are kept beside the events table, so that a front page doesn't read events.

Every (day, batch) directory of the table has one of partial aggregates: requests and a visitor sketch by hour, site
and label. Requests add up exactly; sketches are merged, so visitors of any range, over any hours and sites, are an
estimate whose error doesn't grow with the range. A batch that is replayed replaces its aggregates like its events,
late hours are further rows, and days that a run has relabelled are worked out anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.labels import norm_site
from visitlens.operators.filters import as_timestamp
from visitlens.sources.sinks import LAYOUT, read_days
from visitlens.sources.upkeep import remove_folder, day_paths

#: Buckets of a sketch, as a power of two: a standard error of 0.8 %, and exact for few visitors.
SKETCH_BITS = 14
KEYS = ("hour", "site", "bot_classification", "bot_name")
PARTS = T.StructType(
    [
        T.StructField("hour", T.TimestampType()),
        T.StructField("site", T.StringType()),
        T.StructField("bot_classification", T.StringType()),
        T.StructField("bot_name", T.StringType()),
        T.StructField("requests", T.LongType()),
        T.StructField("visitors", T.BinaryType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def hour_parts(events: DataFrame) -> DataFrame:
    """Partial aggregates of stored events by directory, hour, site and label."""
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    sketch = F.hll_sketch_agg("client_ip", F.lit(SKETCH_BITS)).alias("visitors")
    keys = [hour, norm_site().alias("site"), "bot_classification", "bot_name", *LAYOUT]
    found = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), sketch)
    return found.select(*[f.name for f in PARTS.fields])


def keep(events: DataFrame, path: str) -> None:
    """Writes the aggregates of whole directories, replacing those they had."""
    hour_parts(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def keep_batch(spark: SparkSession, events_path: str, path: str, batch_id: int, days: Iterable[dt.date]) -> None:
    """The aggregates of a batch of the stream; only its own directories are read."""
    stored = read_days(spark, events_path, days)
    if stored is not None:
        keep(stored.where(F.col("batch_id") == batch_id), path)


def rebuild(spark: SparkSession, events_path: str, path: str, days: Iterable[dt.date]) -> None:
    """Works out the aggregates of some days anew, after a run has relabelled, merged or removed their directories."""
    days = list(days)
    for place in day_paths(spark, path, days):
        remove_folder(spark, place)
    stored = read_days(spark, events_path, days)
    if stored is not None:
        keep(stored, path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path)


def summed(parts: DataFrame, by: Sequence[str] = (), start: dt.datetime | str | None = None, end: dt.datetime | str | None = None) -> DataFrame:
    """Requests and visitors of the hours from ``start`` up to ``end`` by some of ``KEYS``.

    Days outside the range aren't read. Sketches of one group are merged on the map side, so a busy group is no
    large task. Visitors are an estimate, see ``SKETCH_BITS``.
    """
    for edge, upper in ((start, False), (end, True)):
        if edge is not None:
            at = as_timestamp(edge)
            day, hour = F.lit(at.date()), F.lit(at)
            parts = parts.where((F.col("event_date") <= day) & (F.col("hour") < hour) if upper else (F.col("event_date") >= day) & (F.col("hour") >= hour))
    visitors = F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors")
    return parts.groupBy(*by).agg(F.sum("requests").alias("requests"), visitors)

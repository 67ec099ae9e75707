"""Which directories of the events table can hold a batch's rows at all.

A key holds its time, so a stored row can only equal a row of a batch if both fall on one second. Every (day, batch)
directory that the stream writes has the set of its seconds kept here as bitmaps: three at most, 12 KB, however many rows
it has. A batch reads keys of the directories that share a second with it, and of those without a set: loads and merged days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.sources.sinks import LAYOUT, TABLE, day_paths
from visitlens.sources.upkeep import names

DAY = 86_400
TIMES = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("seconds", T.BinaryType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def bitmaps(rows: DataFrame, by) -> DataFrame:
    """The seconds of the day at which a group has rows, as bitmaps; tasks send theirs merged."""
    second = F.pmod(F.unix_seconds("timestamp"), F.lit(DAY)) + 1
    groups = rows.withColumn("_second", second).groupBy(*by, F.bitmap_bucket_number("_second").alias("bucket"))
    return groups.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_second")).alias("seconds"))


def keep_times(events: DataFrame, path: str) -> None:
    """Writes the sets of whole directories of the stream, replacing those they had."""
    found = bitmaps(events, LAYOUT).select(*TIMES.fieldNames())
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def _directories(spark: SparkSession, path: str, days: Iterable[dt.date]) -> set[tuple[dt.date, int]]:
    found = set()
    for day in days:
        listed = (name for name, _ in names(spark, f"{path}/event_date={day}"))
        found |= {(day, int(name.removeprefix("batch_id="))) for name in listed if name.startswith("batch_id=")}
    return found


def may_hold(batch: DataFrame, events_path: str, path: str, days: Iterable[dt.date]) -> list[tuple[dt.date, int]]:
    """The directories of the batch's days that may hold rows of the batch; the bitmaps are all that is read."""
    spark, days = batch.sparkSession, list(days)
    there = _directories(spark, events_path, days)
    known = _directories(spark, path, days)
    shared: set[tuple[dt.date, int]] = set()
    if known:
        kept = spark.read.schema(TIMES).option("basePath", path).parquet(*day_paths(spark, path, days))
        own = bitmaps(batch.withColumn("event_date", F.to_date("timestamp")), ["event_date"]).withColumnRenamed("seconds", "_own")
        pairs = kept.join(F.broadcast(own), ["event_date", "bucket"]).withColumn("_bits", F.explode(F.array("seconds", "_own")))
        common = pairs.groupBy(*LAYOUT, "bucket").agg(F.bitmap_and_agg("_bits").alias("both")).where(F.bitmap_count("both") > 0)
        shared = {(r.event_date, r.batch_id) for r in common.select(*LAYOUT).distinct().collect()}  # directories
    return sorted(d for d in there if d in shared or d not in known)


def read_candidates(batch: DataFrame, events_path: str, path: str, days: Iterable[dt.date]) -> DataFrame | None:
    """The stored rows of the directories that may hold rows of the batch; None if there are none."""
    found = [f"{events_path}/event_date={day}/batch_id={number}" for day, number in may_hold(batch, events_path, path, days)]
    return batch.sparkSession.read.schema(TABLE).option("basePath", events_path).parquet(*found) if found else None

"""Rate rules at ingestion: how busy an address is on a day, over all batches of a stream.

A session of the rules is an address's day. Every (day, batch) directory of the events table has one here, with
requests, first and last time by address, so a batch that is replayed replaces its own. Labels of a batch use the sums
over all directories of its days. Where a batch takes an address's day across the rate threshold, either way as a longer
span also slows it down, rows that earlier batches stored for that day are relabelled. Labels therefore don't depend on
how lines are cut into batches, nor on their order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions import rules
from visitlens.functions.metrics import requests, seconds_between
from visitlens.operators.changes import ROW_KEYS, relabel
from visitlens.operators.classify import VERDICT_FIELDS, classify_v2
from visitlens.operators.skew import spread_join
from visitlens.sources.sinks import LAYOUT, day_paths, read_days
from visitlens.sources.upkeep import days_of, remove_folder
from visitlens.streaming.scratch import shared_dir, staged

#: The columns that the label rules read.
STATS = ("request_count", "span_seconds")
ACTIVITY = T.StructType(
    [
        T.StructField("client_ip", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("first", T.TimestampType()),
        T.StructField("last", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def keep_activity(events: DataFrame, path: str) -> None:
    """Writes the activity of whole directories, replacing those they had; ``events`` have the columns of ``LAYOUT``."""
    found = events.where(F.col("client_ip").isNotNull()).groupBy("client_ip", *LAYOUT)
    found = found.agg(requests("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    found = found.select(*[f.name for f in ACTIVITY.fields])
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def rebuild(spark: SparkSession, events_path: str, path: str, days: Iterable[dt.date]) -> None:
    """Works out the activity of some days anew, after loads, merging or removal of their directories."""
    days = list(days)
    for place in day_paths(spark, path, days):
        remove_folder(spark, place)
    stored = read_days(spark, events_path, days)
    if stored is not None:
        keep_activity(stored, path)


def read_activity(spark: SparkSession, path: str, days: Iterable[dt.date]) -> DataFrame:
    """The activity of some days; only their directories are listed."""
    there = day_paths(spark, path, days)
    return spark.read.schema(ACTIVITY).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], ACTIVITY)


def session_key() -> Column:
    """One value for an address's day; NULL without an address."""
    return F.when(F.col("client_ip").isNotNull(), F.concat_ws(" ", "event_date", "client_ip"))


def sessions(parts: DataFrame, batch_id: int) -> DataFrame:
    """Every address's day with its statistics now, those without the batch (``was_...``), and the batch's own requests."""
    own = F.col("batch_id") == batch_id
    before = lambda c: F.when(~own, F.col(c))
    return parts.groupBy(session_key().alias("_session")).agg(
        F.sum("n").alias("request_count"),
        seconds_between(F.min("first"), F.max("last")).alias("span_seconds"),
        F.sum(before("n")).alias("was_request_count"),
        seconds_between(F.min(before("first")), F.max(before("last"))).alias("was_span_seconds"),
        F.sum(F.when(own, F.col("n"))).alias("_own"),
    )


def with_activity(rows: DataFrame, parts: DataFrame, batch_id: int) -> DataFrame:
    """A batch's rows with the statistics of their address's day, this batch included."""
    stats = sessions(parts, batch_id).where("_own > 0").select("_session", *STATS, "_own")
    return spread_join(rows.withColumn("_session", session_key()), stats, "_session", "_own").drop("_session")


def _fast(count: str, span: str) -> Column:
    return F.coalesce((F.col(span) > 0) & (F.try_divide(F.col(count), F.col(span)) > rules.HUMAN_MAX_RATE), F.lit(False))


def amendments(stored: DataFrame, parts: DataFrame, batch_id: int, path_aware: bool = True) -> DataFrame:
    """Changes to the rows of earlier batches whose label the batch's requests have changed.

    Only days of addresses that crossed the threshold are looked at, and only rows that still have the label that the
    rules gave them: labels from other runs stay.
    """
    turned = sessions(parts, batch_id).where(_fast(*STATS) != _fast("was_request_count", "was_span_seconds"))
    turned = turned.where("_own > 0 and was_request_count > 0").drop("_own").withColumn("_rows", F.col("was_request_count"))
    earlier = stored.where(F.col("batch_id") != batch_id).withColumn("_session", session_key())
    rows = spread_join(earlier, turned, "_session", "_rows", "inner")
    now = classify_v2(rows, path_aware, "headers_json", "_now").drop(*STATS)
    both = classify_v2(now.withColumnsRenamed({f"was_{c}": c for c in STATS}), path_aware, "headers_json", "_was")
    kept = [c for c in VERDICT_FIELDS if c in stored.columns]
    same = F.lit(True)
    for c in kept:
        same = same & F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    return both.where(same & ~F.col("_now").eqNullSafe(F.col("_was"))).select(*ROW_KEYS, *[F.col(f"_now.{c}").alias(c) for c in kept])


def amend(spark: SparkSession, events_path: str, path: str, batch_id: int, days: Iterable[dt.date], path_aware: bool = True) -> list[dt.date]:
    """Relabels what a batch has changed for earlier ones and returns the days it has touched.

    The comparison is with the state without the batch, so a batch that is replayed after a failure finds the same
    addresses, and the rows that are relabelled already are left alone. Raises the commit's conflict if somebody else
    rewrote a directory meanwhile; the stream then repeats the batch.
    """
    days = list(days)
    stored = read_days(spark, events_path, days)
    if stored is None:
        return []
    changes = staged(amendments(stored, read_activity(spark, path, days), batch_id, path_aware), "amendments")
    touched = days_of(changes)
    if touched:
        remove_folder(spark, relabel(spark, events_path, changes, shared_dir(spark, "amended")))
    return touched

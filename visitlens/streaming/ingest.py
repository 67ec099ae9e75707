"""Structured Streaming: incremental ingestion, deduplication, windows and sessions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.functions.ip import subnet_of
from visitlens.functions.labels import norm_site
from visitlens.functions.requests import EVENT_KEYS, bot_headers, browser_signals, event_key, security_flags
from visitlens.operators.classify import classify_v2, unpack
from visitlens.operators.enrich import enrich
from visitlens.operators.filters import (
    as_timestamp,
    drop_banned,
    drop_home,
    drop_scanners,
    drop_sites,
)
from visitlens.operators.ranges import prepared
from visitlens.schema import PROGRESS
from visitlens.settings import DEFAULT, Settings
from visitlens.sources.dims import last_mark, read_bans
from visitlens.sources.logs import parse_logs, read_lines, split_lines, split_read, stream_logs
from visitlens.sources.sinks import read_days, to_stored, write_events
from visitlens.streaming.activity import amend, keep_activity, read_activity, with_activity
from visitlens.streaming.kept import keep_batch, rebuild
from visitlens.streaming.scratch import held, staged
from visitlens.streaming.times import keep_times, read_candidates

INGEST_INTERVAL = "10 minutes"


def wanted(events: DataFrame, settings: Settings = DEFAULT, bans: DataFrame | None = None) -> DataFrame:
    """Drops home, excluded-site, scanner and banned traffic."""
    df = drop_home(events, settings.home_ips, settings.home_subnets)
    df = drop_scanners(drop_sites(df, settings.excluded_sites))
    return df if bans is None else drop_banned(df, bans)


def build_events(
    parsed: DataFrame,
    geo: DataFrame,
    networks: DataFrame,
    path_aware: bool = True,
    extra_asns: dict[int, str] | None = None,
    prefer_header: bool = False,
) -> DataFrame:
    """Parsed requests to full events: network, label and flag columns."""
    df = enrich(parsed, geo, networks, extra_asns, prefer_header)
    df = unpack(classify_v2(df, path_aware=path_aware))
    df = df.withColumn("subnet", subnet_of(F.col("client_ip")))
    df = df.withColumns({**browser_signals(), **bot_headers(), **security_flags(F.col("path"))})
    return df.withColumnRenamed("headers", "headers_json")


def starting_mark(progress: DataFrame | None, now: dt.datetime) -> dt.datetime:
    """Where to take up ingestion: the newest progress mark, or an hour ago on the first run."""
    row = None if progress is None else last_mark(progress).first()
    return row[0] if row and row[0] else now - dt.timedelta(hours=1)


def dedup_stream(df: DataFrame, keys=EVENT_KEYS, delay: str = "1 hour") -> DataFrame:
    """Drops repeats of a key seen within the watermark delay.

    Rows later than the delay are dropped as well, so this is for streams whose lateness is bounded.
    Ingestion doesn't use it: it compares every batch with the stored table.
    """
    return df.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


@dataclass(frozen=True)
class Ingestion:
    """Everything one ingestion run needs besides the log folder.

    ``since`` is a time, or ``"mark"`` to take up where the stored progress ends, an hour ago on the
    first run. Unreadable lines go to ``bad_path`` if there is one, and hourly aggregates of what is
    stored to ``kept_path``. With ``activity_path`` the rate rules apply, see :mod:`visitlens.streaming.activity`,
    and with ``times_path`` a batch reads keys of those directories only that share a second with it.
    """

    events_path: str
    progress_path: str
    checkpoint: str
    geo: DataFrame
    networks: DataFrame
    bans_path: str | None = None
    settings: Settings = DEFAULT
    since: dt.datetime | str | None = None
    path_aware: bool = True
    max_files: int | None = None
    bad_path: str | None = None
    kept_path: str | None = None
    activity_path: str | None = None
    times_path: str | None = None


def unstored(batch: DataFrame, batch_id: int, path: str, times_path: str | None = None) -> DataFrame:
    """The rows of a batch, each once, that no other batch or load has stored, however late they come.

    Only the days the batch touches are read, and of those only the keys.
    """
    once = batch.dropDuplicates(list(EVENT_KEYS))
    days = [r[0] for r in batch.select(F.to_date("timestamp")).distinct().collect()]  # one value a day
    stored = read_candidates(batch, path, times_path, days) if times_path else read_days(batch.sparkSession, path, days)
    if stored is None:
        return once
    return once.join(stored.where(F.col("batch_id") != batch_id).select(*EVENT_KEYS), list(EVENT_KEYS), "left_anti")


def write_batch(batch: DataFrame, batch_id: int, job: Ingestion) -> None:
    """Enriches and stores one batch.

    A batch owns its ``batch_id`` directories and overwrites them, so a batch that is replayed
    after a failure replaces its own output instead of adding to it. The ban list is read anew.
    """
    spark = batch.sparkSession
    started = dt.datetime.now(dt.timezone.utc)
    bans = read_bans(spark, job.bans_path) if job.bans_path else None
    with held(unstored(wanted(batch, job.settings, bans), batch_id, job.events_path, job.times_path), "fresh") as fresh:
        written = Observation("written")
        rows, days = fresh, []
        own = fresh.withColumns({"event_date": F.to_date("timestamp"), "batch_id": F.lit(batch_id).cast("bigint")})
        if job.times_path:
            # Before the events, so that no directory has a set that lacks rows of it.
            keep_times(own, job.times_path)
        if job.kept_path or job.activity_path:
            days = [r[0] for r in fresh.select(F.to_date("timestamp")).distinct().collect()]  # one value a day
        if job.activity_path:
            keep_activity(own, job.activity_path)
            rows = with_activity(own, read_activity(spark, job.activity_path, days), batch_id)
        events = to_stored(build_events(rows, job.geo, job.networks, job.path_aware)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        metrics = (F.max("timestamp").alias("newest"), F.max_by("cf_ray", "timestamp").alias("ray"), F.count(F.lit(1)).alias("rows"))
        write_events(events.observe(written, *metrics), job.events_path)
        seen = written.get
        if job.kept_path and seen["rows"]:
            keep_batch(spark, job.events_path, job.kept_path, batch_id, days)
        if job.activity_path and seen["rows"]:
            amended = amend(spark, job.events_path, job.activity_path, batch_id, days, job.path_aware)
            if job.kept_path and amended:
                rebuild(spark, job.events_path, job.kept_path, amended)
    if not seen["rows"]:
        return
    now = dt.datetime.now(dt.timezone.utc)
    row = (seen["newest"], seen["ray"], seen["rows"], int((now - started).total_seconds() * 1000), now)
    progress = spark.createDataFrame([row], PROGRESS).withColumn("batch_id", F.lit(batch_id))
    progress.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(job.progress_path)


def take_lines(lines: DataFrame, batch_id: int, job: Ingestion, since: dt.datetime | None = None) -> None:
    """Parses a batch of log lines once, stores its events and sets its unreadable lines aside."""
    # Of lines that can be read, the text isn't needed any more.
    text = F.when(~F.col("usable"), F.col("line"))
    with held(read_lines(lines).withColumn("line", text), "lines") as read:
        good, bad = split_read(read)
        if job.bad_path:
            bad.write.mode("overwrite").text(f"{job.bad_path}/batch_id={batch_id}")
        parsed = parse_logs(good)
        if since is not None:
            parsed = parsed.where(F.col("timestamp") >= F.lit(since))
        write_batch(parsed.withColumn("id", event_key(parsed.columns)), batch_id, job)


def beginning(spark: SparkSession, job: Ingestion) -> dt.datetime | None:
    """The time before which a run leaves lines out."""
    if job.since != "mark":
        return None if job.since is None else as_timestamp(job.since)
    place = spark._jvm.org.apache.hadoop.fs.Path(job.progress_path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return starting_mark(spark.read.schema(PROGRESS).parquet(job.progress_path) if known else None, dt.datetime.now())


def ingest_stream(spark: SparkSession, source: str, job: Ingestion, interval: str | None = None) -> StreamingQuery:
    """Starts ingestion of a log folder.

    Without ``interval`` it takes what is there and ends; with one, such as ``INGEST_INTERVAL``,
    it keeps running. Offsets live in the checkpoint; what is stored decides what is new.
    """
    since = beginning(spark, job)
    # Flattened once for all batches.
    job = replace(job, geo=prepared(job.geo, "geo"), networks=prepared(job.networks, "networks"))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream_logs(spark, source, job.max_files)
        .writeStream.foreachBatch(lambda lines, batch_id: take_lines(lines, batch_id, job, since))
        .option("checkpointLocation", job.checkpoint)
        .trigger(**trigger)
        .start()
    )


def bad_lines_stream(
    spark: SparkSession, source: str, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Stores unreadable lines only, for sources that nothing ingests; ingestion sets its own aside."""
    _, bad = split_lines(stream_logs(spark, source))
    writer = bad.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def timeline_stream(df: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Visitors and requests per site and tumbling window, counted per visitor first, so both are exact."""
    visitors = (
        df.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", size).alias("window"), norm_site().alias("site"), "client_ip")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        visitors.groupBy(F.window(F.window_time("window"), size).alias("window"), "site")
        .agg(F.count("client_ip").alias("count"), F.sum("n").alias("requests"))
        .select(F.col("window.start").alias("time_bucket"), "site", "count", "requests")
    )


def with_open(streamed: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """What a stream has written, and from a batch run of the same report the groups it has not closed yet.

    A stream keeps windows and sessions until the watermark passes them; at the end of a bounded input
    nothing moves the watermark any more, and this completes the result.
    """
    # Staged, as the planner would move the anti join below the merging of sessions, which changes them.
    whole = staged(batch, "report")
    return streamed.unionByName(whole.join(streamed.select(*keys), list(keys), "left_anti").select(*streamed.columns))


def sessions_stream(df: DataFrame, gap: str | Column = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests and span of each address's sessions, closed after ``gap`` without a request."""
    return (
        df.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap).alias("session"), "client_ip")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("span_seconds"),
        )
        .select("client_ip", F.col("session.start").alias("session_start"), "request_count", "span_seconds")
    )

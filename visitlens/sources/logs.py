"""Access-log lines: scan, split into good and bad, parse into event columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.requests import (
    blank_to_null,
    client_ip_expr,
    first_value,
    or_default,
    split_uri,
    to_event_time,
)
from visitlens.operators.filters import as_timestamp
from visitlens.schema import RAW_LOG

ACCESS_LOGGER = "http.log.access"
CORRUPT = "_corrupt"
PARSED = T.StructType(RAW_LOG.fields + [T.StructField(CORRUPT, T.StringType())])


def is_access_log(line: Column | None = None) -> Column:
    """Access records, tested on the raw line or, without one, on the parsed record."""
    if line is not None:
        return line.contains(ACCESS_LOGGER)
    return F.col("logger").startswith(ACCESS_LOGGER) & F.col("request").isNotNull()


def read_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Access lines with the fields of their record and whether it is ``usable``.

    Other loggers are dropped on the raw text before any JSON is read. A line is bad when it is
    not JSON, has no usable time or names no client.
    """
    text = F.col(value)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # ``inline`` puts the parsed fields behind a generator, where a filter on them cannot be pushed
    # back into repeated parses of the line.
    record = F.inline(F.array(F.from_json(text, PARSED, options)))
    parsed = lines.where(is_access_log(text)).select(text.alias("line"), record)
    usable = (
        F.col(CORRUPT).isNull()
        & to_event_time(F.col("ts")).isNotNull()
        & F.coalesce(client_ip_expr("edge"), client_ip_expr("backfill")).isNotNull()
    )
    return parsed.withColumn("usable", F.coalesce(usable, F.lit(False))).drop(CORRUPT)


def split_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of a frame of text lines."""
    return split_read(read_lines(lines, value))


def split_read(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    return read.where("usable").drop("line", "usable"), read.where("not usable").select("line")


def read_logs(spark: SparkSession, path: str, since: dt.datetime | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch scan of log files, optionally from a progress mark on; returns (records, bad lines)."""
    good, bad = split_lines(spark.read.text(path))
    if since is not None:
        good = good.where(to_event_time(F.col("ts")) >= F.lit(as_timestamp(since)))
    return good, bad


def read_logs_range(spark: SparkSession, path: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Records of whole days from ``start`` through ``end``.

    When the files lie in ``event_date=`` directories only those days are listed.
    """
    start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    lines = spark.read.text(path)
    if "event_date" in lines.columns:
        lines = lines.where(F.col("event_date").cast("date").between(F.lit(start), F.lit(end)))
    good, _ = split_lines(lines)
    good = good.where(is_access_log())
    first = dt.datetime.combine(start, dt.time())
    after = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
    ts = to_event_time(F.col("ts"))
    return good.where((ts >= F.lit(first)) & (ts < F.lit(after)))


def stream_logs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming scan of new log files as text lines; progress lives in the query's checkpoint."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parse_logs(records: DataFrame, mode: str = "edge") -> DataFrame:
    """Event columns known from the record alone, with defaults for missing fields.

    ``backfill`` keeps the whole URI as path, takes the socket address as fallback, and carries the
    country header.
    """
    path, query = split_uri(F.col("request.uri"), mode)
    headers = F.col("request.headers")
    agent = first_value("User-Agent", headers)
    columns = {
        "timestamp": to_event_time(F.col("ts")),
        "duration": or_default(F.col("duration"), 0.0),
        "client_ip": client_ip_expr(mode),
        "cf_ray": first_value("Cf-Ray", headers),
        "site": or_default(blank_to_null(F.col("request.host")), "unknown"),
        "method": or_default(blank_to_null(F.col("request.method")), "GET"),
        "path": path,
        "query_string": query,
        "status": or_default(F.col("status"), 0),
        "response_size": or_default(F.col("size"), 0),
        "content_type": F.lit(None).cast("string"),
        "user_agent": F.coalesce(agent, F.lit("")) if mode == "backfill" else agent,
        "referer": first_value("Referer", headers),
        "accept_language": first_value("Accept-Language", headers),
        "headers": headers,
    }
    if mode == "backfill":
        columns["header_country"] = first_value("Cf-Ipcountry", headers)
    return records.select(*[c.alias(name) for name, c in columns.items()]).where("client_ip is not null")

"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LOG = T.StructType(
    [
        T.StructField("logger", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField(
            "request",
            T.StructType(
                [
                    T.StructField("client_ip", T.StringType()),
                    T.StructField("remote_ip", T.StringType()),
                    T.StructField("host", T.StringType()),
                    T.StructField("method", T.StringType()),
                    T.StructField("uri", T.StringType()),
                    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
                ]
            ),
        ),
    ]
)

# The 35 stored columns, in storage order.
WEB_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("cf_ray", T.StringType()),
        T.StructField("subnet", T.StringType()),
        T.StructField("asn", T.IntegerType()),
        T.StructField("asn_org", T.StringType()),
        T.StructField("datacenter_provider", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query_string", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("response_size", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("bot_classification", T.StringType()),
        T.StructField("bot_name", T.StringType()),
        T.StructField("detection_level", T.IntegerType()),
        T.StructField("referer", T.StringType()),
        T.StructField("accept_language", T.StringType()),
        T.StructField("has_sec_fetch_headers", T.BooleanType()),
        T.StructField("has_client_hints", T.BooleanType()),
        T.StructField("is_mobile", T.BooleanType()),
        T.StructField("bot_from_email", T.StringType()),
        T.StructField("openai_host_hash", T.StringType()),
        T.StructField("has_cf_worker", T.BooleanType()),
        T.StructField("cf_worker_domain", T.StringType()),
        T.StructField("is_exploit_attempt", T.BooleanType()),
        T.StructField("headers_json", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

# What the table on disk adds: a replay-stable key, the rule's reason and the partition column.
STORED_EVENT = T.StructType(
    [T.StructField("id", T.LongType())]
    + WEB_EVENT.fields
    + [T.StructField("detection_reason", T.StringType()), T.StructField("event_date", T.DateType())]
)

# Columns the historical load writes; the other stored columns stay NULL.
BACKFILL_COLUMNS = (
    "timestamp",
    "duration",
    "client_ip",
    "country",
    "city",
    "latitude",
    "longitude",
    "cf_ray",
    "subnet",
    "asn",
    "asn_org",
    "datacenter_provider",
    "site",
    "method",
    "path",
    "status",
    "response_size",
    "user_agent",
    "is_bot",
    "bot_classification",
    "bot_name",
    "detection_level",
    "referer",
    "headers_json",
)

PROGRESS = T.StructType(
    [
        T.StructField("last_processed_timestamp", T.TimestampType()),
        T.StructField("last_cf_ray", T.StringType()),
        T.StructField("records_processed", T.LongType()),
        T.StructField("ingestion_duration_ms", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("bot_classification", T.StringType()),
        T.StructField("bot_name", T.StringType()),
        T.StructField("detection_level", T.IntegerType()),
        T.StructField("detection_reason", T.StringType()),
    ]
)

BAN = T.StructType([T.StructField("value", T.StringType())])

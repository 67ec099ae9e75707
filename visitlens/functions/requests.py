"""Column expressions that read one access-log record: headers, address, URI, time, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import attack_class


# Seconds at the end of the year 9999.
END_OF_TIME = 253_402_300_800
# What tells one request from another.
LOGGED = (
    "cf_ray",
    "timestamp",
    "client_ip",
    "site",
    "path",
    "query_string",
    "method",
    "status",
    "response_size",
    "duration",
    "user_agent",
    "referer",
    "accept_language",
)
EVENT_KEYS = ("id", "timestamp", "client_ip")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def first_value(name: str, headers: Column | str = "headers") -> Column:
    """First value of a header; NULL when the header is absent or its value is empty."""
    bag = F.col(headers) if isinstance(headers, str) else headers
    return blank_to_null(F.get(F.try_element_at(bag, F.lit(name)), F.lit(0)))


def has_any_header(names, headers: Column | str = "headers") -> Column:
    """True when one of the headers has a non-empty value."""
    return F.coalesce(*[first_value(n, headers) for n in names]).isNotNull()


def client_ip_expr(mode: str = "edge", request: str = "request") -> Column:
    """Address of the visitor behind proxies.

    ``edge`` reads the log as ingestion does, ``backfill`` as the historical load does, ``proxy``
    as a request handler sees lower-case header names.
    """
    headers = F.col(f"{request}.headers")
    if mode == "edge":
        return F.coalesce(
            first_value("Cf-Connecting-Ip", headers),
            first_value("X-Forwarded-For", headers),
            blank_to_null(F.col(f"{request}.client_ip")),
        )
    if mode == "backfill":
        return F.coalesce(first_value("Cf-Connecting-Ip", headers), blank_to_null(F.col(f"{request}.remote_ip")))
    if mode == "proxy":
        first_hop = F.trim(F.split_part(first_value("x-forwarded-for", headers), F.lit(","), F.lit(1)), F.lit(" \t\r\n"))
        return F.coalesce(
            first_value("cf-connecting-ip", headers),
            blank_to_null(first_hop),
            first_value("x-real-ip", headers),
            blank_to_null(F.col(f"{request}.remote_ip")),
        )
    raise ValueError(f"unknown address mode: {mode}")


def split_uri(uri: Column, mode: str = "edge") -> tuple[Column, Column]:
    """(path, query). Text after a second question mark is not part of either.

    ``backfill`` keeps the whole URI as the path.
    """
    uri = or_default(blank_to_null(uri), "/")
    if mode == "backfill":
        return uri, F.lit(None).cast("string")
    pieces = F.split(uri, r"\?")
    path = or_default(blank_to_null(F.get(pieces, F.lit(0))), "/")
    return path, blank_to_null(F.get(pieces, F.lit(1)))


def request_line(path: Column, query: Column) -> Column:
    return F.concat_ws("?", path, query)


def to_event_time(ts: Column) -> Column:
    """Fractional epoch seconds to a timestamp cut to milliseconds; NULL before 1970 or after 9999."""
    return F.when((ts >= 0) & (ts < END_OF_TIME), F.timestamp_millis((ts * 1000).try_cast("bigint")))


def browser_signals(headers: Column | str = "headers", version: int = 2) -> dict[str, Column]:
    """Stored browser flags. Version 2 counts a fourth Sec-Fetch header."""
    sec_fetch = rules.SEC_FETCH_STORED if version == 2 else rules.SEC_FETCH
    return {
        "has_sec_fetch_headers": has_any_header(sec_fetch, headers),
        "has_client_hints": has_any_header(rules.CLIENT_HINTS, headers),
        "is_mobile": or_default(first_value("Sec-Ch-Ua-Mobile", headers) == "?1", False),
    }


def bot_headers(headers: Column | str = "headers") -> dict[str, Column]:
    return {
        "bot_from_email": first_value("From", headers),
        "openai_host_hash": first_value("X-Openai-Host-Hash", headers),
    }


def security_flags(path: Column, headers: Column | str = "headers", version: int = 2) -> dict[str, Column]:
    """Edge-worker and exploit flags. Version 1 tests plain path prefixes."""
    worker = first_value("Cf-Worker", headers)
    if version == 2:
        exploit = attack_class(path).isNotNull()
    else:
        exploit = F.lit(False)
        for prefix in rules.EXPLOIT_PREFIXES_V1:
            exploit = exploit | path.startswith(prefix)
    return {
        "has_cf_worker": worker.isNotNull(),
        "cf_worker_domain": worker,
        "is_exploit_attempt": or_default(exploit, False),
    }


def event_key(columns) -> Column:
    """Replay-stable 64-bit key of one request: every column it was logged with, and which of them are NULL.

    Over very many requests a key is only unique together with time and address (``EVENT_KEYS``).
    """
    known = [c for c in LOGGED if c in columns]
    return F.xxhash64(*known, *[F.col(c).isNull() for c in known])

"""Row filters. All are plain predicates, so Catalyst pushes them into the scan where it can."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.ip import in_subnet
from visitlens.functions.labels import col, either, ilike_any
from visitlens.functions.matching import fold, matches_any
from visitlens.functions.requests import request_line
from visitlens.operators.once import computed_once
from visitlens.settings import DEFAULT, Settings

RANGES = {"6h": 6, "24h": 24, "7d": 7 * 24, "30d": 30 * 24}


def as_timestamp(as_of: dt.datetime | str) -> dt.datetime:
    return dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def since(df: DataFrame, hours: float, as_of: dt.datetime | str) -> DataFrame:
    """Rows strictly younger than ``hours`` at ``as_of``, and not after it.

    Where the table is partitioned by ``event_date`` the derived date bounds prune partitions.
    """
    end = as_timestamp(as_of)
    start = end - dt.timedelta(hours=hours)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date").between(F.lit(start.date()), F.lit(end.date())))
    return df.where((F.col("timestamp") > F.lit(start)) & (F.col("timestamp") <= F.lit(end)))


def in_range(df: DataFrame, rng: str, as_of: dt.datetime | str) -> DataFrame:
    """Named range 6h, 24h, 7d or 30d; any other name means 24h."""
    return since(df, RANGES.get(rng, RANGES["24h"]), as_of)


def drop_ips(df: DataFrame, ips=DEFAULT.excluded_ips) -> DataFrame:
    return df.where(~F.col("client_ip").isin(*ips))


def topic_only(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """All rows of other sites, and of the topic site only those on topic paths.

    The host is compared exactly, so its ``www.`` form is not narrowed.
    """
    site, path = F.col("site"), F.col("path")
    on_topic = either([path.ilike(p) for p in settings.topic_ilike] + [path.like(p) for p in settings.topic_like])
    return df.where((site != settings.topic_site) | on_topic)


def scope(
    events: DataFrame,
    rng: str,
    as_of: dt.datetime | str,
    settings: Settings = DEFAULT,
    on_topic: bool = False,
) -> DataFrame:
    """The filter every dashboard and explorer report starts from."""
    df = drop_ips(in_range(events, rng, as_of), settings.excluded_ips)
    return topic_only(df, settings) if on_topic else df


def drop_home(df: DataFrame, ips=DEFAULT.home_ips, subnets=DEFAULT.home_subnets) -> DataFrame:
    ip = F.col("client_ip")
    return df.where(~(ip.isin(*ips) | either(in_subnet(ip, s) for s in subnets)))


def drop_banned(df: DataFrame, bans: DataFrame) -> DataFrame:
    """Anti join with the ban list (distinct ``value``); the planner sizes the list itself."""
    return df.join(bans.select(F.col("value").alias("client_ip")), "client_ip", "left_anti")


def drop_sites(df: DataFrame, sites=DEFAULT.excluded_sites) -> DataFrame:
    return df.where(~F.col("site").isin(*sites))


def keep_sites(df: DataFrame, sites=DEFAULT.listed_hosts) -> DataFrame:
    return df.where(F.col("site").isin(*sites))


def drop_scanners(df: DataFrame) -> DataFrame:
    df = computed_once(df, "_uri", fold(request_line(F.col("path"), F.col("query_string"))))
    return df.where(~matches_any(F.col("_uri"), rules.SCANNER_URIS)).drop("_uri")


def org_like(words, org: Column | str = "asn_org") -> Column:
    return ilike_any(org, words)


def asn_in(numbers, asn: Column | str = "asn") -> Column:
    return col(asn).isin(*numbers)


def ip_prefix(prefix: str, ip: Column | str = "client_ip") -> Column:
    return col(ip).startswith(prefix)


def skip_loaded_days(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows of days the table does not hold yet. At most one row per day reaches the join."""
    loaded = existing.select("event_date").distinct()
    return new.join(loaded, "event_date", "left_anti")


def between_times(df: DataFrame, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Rows from ``start`` up to but not including ``end``."""
    start, end = as_timestamp(start), as_timestamp(end)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date").between(F.lit(start.date()), F.lit(end.date())))
    return df.where((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))


def expire(df: DataFrame, as_of: dt.datetime | str, days: int = DEFAULT.retention_days) -> DataFrame:
    """Rows still inside the retention period; prunes whole partitions."""
    return df.where(F.col("event_date") > F.lit((as_timestamp(as_of) - dt.timedelta(days=days)).date()))

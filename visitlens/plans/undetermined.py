"""Reports on traffic the rules could not place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.labels import no_agent, ua_family, undetermined_reason
from visitlens.functions.metrics import (
    active_seconds,
    count_where,
    distinct,
    fixed_round,
    percent,
    req_rate,
    requests,
    seconds_between,
    sorted_values,
)
from visitlens.operators.filters import drop_ips, since
from visitlens.plans.common import evidence, largest_first, rank_then_detail, top
from visitlens.settings import DEFAULT


def undetermined(events: DataFrame, without_ips=()) -> DataFrame:
    df = events.where(F.col("bot_classification") == "bot_undetermined")
    return drop_ips(df, without_ips) if without_ips else df


def _share(condition, name: str):
    """Rounded percentage of rows for which a condition holds; NULL counts as no."""
    return fixed_round(F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100, 0).alias(name)


FROM_DATACENTER = "datacenter_provider is not null"


def totals(df: DataFrame, distincts: dict[str, str], counted: dict[str, Column]) -> DataFrame:
    """Requests, first and last time, distinct counts and conditional counts in one row.

    Several distinct counts multiply the rows they are computed on, so rows are first combined per
    combination of the counted columns.
    """
    parts = df.groupBy(*distincts).agg(
        requests("total_requests"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        *[count_where(condition, name) for name, condition in counted.items()],
    )
    return parts.agg(
        *[F.sum(name).alias(name) for name in ("total_requests", *counted)],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *[distinct(c, name) for c, name in distincts.items()],
    ).na.fill(0)


def overview(events: DataFrame, ips=DEFAULT.home_ips) -> DataFrame:
    """Eleven measures and the shares printed beside them, in one row."""
    row = totals(
        undetermined(events, ips),
        {"client_ip": "unique_ips", "path": "unique_paths", "user_agent": "unique_user_agents"},
        {
            "from_datacenters": F.expr(FROM_DATACENTER),
            "from_residential": F.col("datacenter_provider").isNull(),
            "with_sec_fetch": F.col("has_sec_fetch_headers"),
            "with_client_hints": F.col("has_client_hints"),
            "no_user_agent": no_agent(),
        },
    )
    shares = ("from_datacenters", "from_residential", "with_sec_fetch", "with_client_hints", "no_user_agent")
    return row.withColumns({f"{c}_pct": percent(c, "total_requests", 1) for c in shares})


def signal_overview(events: DataFrame) -> DataFrame:
    """Ten measures with the missing signals counted."""
    return totals(
        undetermined(events),
        {"client_ip": "unique_ips", "path": "unique_paths", "site": "sites_affected"},
        {
            "missing_sec_fetch": ~F.col("has_sec_fetch_headers"),
            "missing_client_hints": ~F.col("has_client_hints"),
            "no_user_agent": no_agent(),
            "from_datacenter": F.expr(FROM_DATACENTER),
        },
    )


def top_agents(events: DataFrame, limit: int | None = 15, ips=DEFAULT.home_ips) -> DataFrame:
    df = undetermined(events, ips).where(~no_agent())
    return rank_then_detail(
        df,
        ("user_agent",),
        limit,
        [distinct("client_ip", "unique_ips"), distinct("path", "unique_paths")],
        count="request_count",
    )


def by_provider(events: DataFrame, ips=DEFAULT.home_ips) -> DataFrame:
    groups = (
        undetermined(events, ips)
        .where(FROM_DATACENTER)
        .groupBy("datacenter_provider")
        .agg(
            requests("request_count"),
            distinct("client_ip", "unique_ips"),
            _share(F.col("has_sec_fetch_headers"), "pct_with_sec_fetch"),
        )
    )
    return groups.orderBy(*largest_first("request_count", ["datacenter_provider"]))


def active_ips(events: DataFrame, limit: int | None = 20, ips=DEFAULT.home_ips) -> DataFrame:
    """Busiest addresses with their agents and request rate; no rate for a single instant."""
    found = rank_then_detail(
        undetermined(events, ips),
        ("client_ip", "datacenter_provider", "country", "asn_org", "has_sec_fetch_headers", "has_client_hints"),
        limit,
        [
            distinct("path", "unique_paths"),
            sorted_values(F.col("user_agent")).alias("user_agents"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        ],
        count="request_count",
    )
    span = seconds_between(F.col("first_seen"), F.col("last_seen"))
    return found.withColumn("req_per_sec", req_rate(F.col("request_count"), span, zero="null", digits=3))


def active_ip_agents(events: DataFrame, limit: int | None = 20, ips=DEFAULT.home_ips) -> DataFrame:
    """Every agent of the addresses that :func:`active_ips` lists, one row each."""
    keys = ("client_ip", "datacenter_provider", "country", "asn_org", "has_sec_fetch_headers", "has_client_hints")
    rows = undetermined(events, ips)
    listed = top(rows.groupBy(*keys).agg(requests("request_count")), "request_count", keys, limit)
    return evidence(rows, listed, keys, "user_agent")


def top_paths(events: DataFrame, limit: int | None = 25, ips=DEFAULT.home_ips) -> DataFrame:
    return rank_then_detail(
        undetermined(events, ips), ("path",), limit, [distinct("client_ip", "unique_ips")], count="request_count"
    )


def by_hour(events: DataFrame, ips=DEFAULT.home_ips) -> DataFrame:
    return undetermined(events, ips).groupBy(F.hour("timestamp").alias("hour")).agg(requests("request_count")).orderBy("hour")


def by_country(events: DataFrame, limit: int | None = 15, ips=DEFAULT.home_ips) -> DataFrame:
    groups = (
        undetermined(events, ips)
        .where(F.col("country").isNotNull())
        .groupBy("country")
        .agg(
            requests("request_count"),
            distinct("client_ip", "unique_ips"),
            _share(F.expr(FROM_DATACENTER), "pct_datacenter"),
        )
    )
    return top(groups, "request_count", ["country"], limit)


def behaviour_profile(events: DataFrame, ips=DEFAULT.home_ips) -> DataFrame:
    """How many addresses saw one path, five or more paths, or made ten or more requests.

    Counting per (address, path) first keeps a busy address spread over its paths.
    """
    per_path = undetermined(events, ips).groupBy("client_ip", "path").agg(requests("n"))
    per_ip = per_path.groupBy("client_ip").agg(F.count("path").alias("paths"), F.sum("n").alias("requests"))
    return per_ip.agg(
        count_where(F.col("paths") == 1, "single_path_ips"),
        count_where(F.col("paths") >= 5, "multi_path_ips"),
        count_where(F.col("requests") >= 10, "repeat_ips"),
    )


def signal_ips(events: DataFrame, limit: int | None = 20) -> DataFrame:
    """Busiest addresses per signal combination with a sample of their attributes."""
    return rank_then_detail(
        undetermined(events),
        ("client_ip", "has_sec_fetch_headers", "has_client_hints"),
        limit,
        [
            distinct("path", "unique_paths"),
            F.max("user_agent").alias("sample_ua"),
            F.max("datacenter_provider").alias("datacenter"),
            F.max("country").alias("country"),
            F.max("city").alias("city"),
        ],
        count="request_count",
    )


def site_paths(events: DataFrame, limit: int | None = 30) -> DataFrame:
    return rank_then_detail(
        undetermined(events),
        ("path",),
        limit,
        [distinct("client_ip", "unique_ips"), F.max("site").alias("site")],
        count="hit_count",
    )


def agent_families(events: DataFrame) -> DataFrame:
    groups = (
        undetermined(events)
        .groupBy(ua_family().alias("ua_pattern"))
        .agg(requests(), distinct("client_ip", "unique_ips"))
    )
    return groups.orderBy(*largest_first("count", ["ua_pattern"]))


def provider_counts(events: DataFrame) -> DataFrame:
    groups = (
        undetermined(events)
        .groupBy("datacenter_provider")
        .agg(requests("request_count"), distinct("client_ip", "unique_ips"))
        .select(
            F.coalesce("datacenter_provider", F.lit("Residential/Unknown")).alias("provider"),
            "request_count",
            "unique_ips",
        )
    )
    return groups.orderBy(*largest_first("request_count", ["provider"]))


def country_counts(events: DataFrame, limit: int | None = 15) -> DataFrame:
    """Grouped by the raw column, so a real ``Unknown`` would stay apart from missing countries."""
    groups = (
        undetermined(events)
        .groupBy("country")
        .agg(requests("request_count"), distinct("client_ip", "unique_ips"))
    )
    best = top(groups, "request_count", ["country"], limit)
    return best.withColumn("country", F.coalesce("country", F.lit("Unknown")))


def reasons(events: DataFrame, digits: int = 1) -> DataFrame:
    """Why rows stayed undetermined, with each reason's share."""
    counts = undetermined(events).groupBy(undetermined_reason().alias("reason")).agg(requests())
    total = counts.agg(
        F.sum("count").alias("total"), F.collect_list(F.struct("reason", "count")).alias("rows")
    ).select("total", F.inline("rows"))
    shares = total.select("reason", "count", percent("count", "total", digits).alias("percentage"))
    return shares.orderBy(*largest_first("count", ["reason"]))


def by_weekday(events: DataFrame) -> DataFrame:
    """Requests per day of the week, Sunday first."""
    number = F.dayofweek("timestamp") - 1
    days = undetermined(events).groupBy(F.date_format("timestamp", "EEEE").alias("day"), number.alias("day_number"))
    return days.agg(requests()).orderBy("day_number")


def fast_ips(events: DataFrame, as_of, limit: int | None = 10, min_rate: float = 0.1) -> DataFrame:
    """Addresses of the last 7 days above a request rate, fastest first."""
    df = since(undetermined(events), 7 * 24, as_of)
    per_ip = df.groupBy("client_ip").agg(requests("request_count"), active_seconds().alias("duration_seconds"))
    rate = F.try_divide("request_count", "duration_seconds")
    order = (rate.desc(), F.col("client_ip"))
    fast = per_ip.where((F.col("duration_seconds") > 0) & (rate > min_rate)).orderBy(*order)
    fast = fast if limit is None else fast.limit(limit)
    # The attributes are only gathered for the addresses listed.
    details = (
        df.join(fast, "client_ip")
        .groupBy("client_ip", "request_count", "duration_seconds")
        .agg(
            distinct("path", "unique_paths"),
            F.max("datacenter_provider").alias("datacenter"),
            F.max("user_agent").alias("sample_ua"),
        )
    )
    return details.orderBy(*order)

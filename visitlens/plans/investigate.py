"""Investigations: hosting networks among residential traffic, address reviews, odd humans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import asn_from_org, ilike_any, org_category, suggest_provider
from visitlens.functions.metrics import (
    active_seconds,
    count_where,
    distinct,
    fixed_round,
    req_rate,
    requests,
    seconds_between,
    sorted_values,
)
from visitlens.operators.filters import as_timestamp, since
from visitlens.operators.reclassify import monitoring_candidates
from visitlens.operators.scoring import legitimacy
from visitlens.plans.common import evidence, first_values, largest_first, rank_then_detail, top
from visitlens.settings import DEFAULT
from visitlens.streaming.scratch import staged

HUMAN = "bot_classification = 'human'"
RESIDENTIAL_HUMAN = "bot_classification = 'human' and datacenter_provider is null"
REVIEWED = ("major_cloud", "cdn_proxy", "telecom_cloud", "hosting_vps")
# Rows listed per category where the listing is cut.
CATEGORY_ROWS = {"hosting_vps": 30, "suspicious": 20}


def unlisted_orgs(events: DataFrame) -> DataFrame:
    """Network owners seen without a provider. A NULL country is not listed."""
    groups = (
        events.where("datacenter_provider is null and asn_org is not null")
        .groupBy("asn", "asn_org", "datacenter_provider")
        .agg(
            requests("request_count"),
            distinct("client_ip", "unique_ips"),
            sorted_values(F.col("country")).alias("countries"),
        )
    )
    return groups.orderBy(*largest_first("request_count", ("asn", "asn_org")))


def categorised_orgs(events: DataFrame) -> DataFrame:
    """Unlisted owners with their review category and the provider label to add."""
    orgs = unlisted_orgs(events)
    category = org_category("asn_org", "request_count", "unique_ips")
    return orgs.withColumn("category", category).withColumn("suggested", suggest_provider("category", "asn_org"))


def category_listing(events: DataFrame, rows: dict[str, int] | None = None) -> DataFrame:
    """Largest owners of every category, cut only where the listing is; an empty ``rows`` cuts nothing."""
    rows = CATEGORY_ROWS if rows is None else rows
    order = Window.partitionBy("category").orderBy(*largest_first("request_count", ("asn", "asn_org")))
    ranked = categorised_orgs(events).where("category is not null").withColumn("rank", F.row_number().over(order))
    keep = F.lit(True)
    for category, n in rows.items():
        keep = keep & ((F.col("category") != category) | (F.col("rank") <= n))
    return ranked.where(keep).select(
        "category", "rank", "asn", "asn_org", "request_count", "unique_ips", "countries", "suggested"
    )


def category_totals(events: DataFrame) -> DataFrame:
    """Owners per category, and the totals of the categories that should be tracked."""
    category, n = F.col("category"), F.col("request_count")
    tracked = category.isin(*REVIEWED)
    return categorised_orgs(events).agg(
        count_where(tracked, "total_hosting"),
        F.coalesce(F.sum(F.when(tracked, n)), F.lit(0)).alias("total_requests"),
        *[count_where(category == c, c) for c in (*REVIEWED, "suspicious")],
    )


def hosting_humans(events: DataFrame, words=rules.ORG_SUSPECT, sample: int | None = 3) -> DataFrame:
    """Owners that sound like hosting companies but send human-labelled traffic.

    ``sample_ips`` shows the first few addresses, or all with ``sample=None``; :func:`hosting_human_ips`
    lists them all as rows.
    """
    rows = events.where(f"{RESIDENTIAL_HUMAN} and asn_org is not null").where(ilike_any("asn_org", words))
    parts = rows.groupBy("asn_org", "client_ip", "path").agg(
        requests("n"), F.bool_and("has_sec_fetch_headers").alias("sec_fetch"), F.bool_and("has_client_hints").alias("hints")
    )
    groups = parts.groupBy("asn_org").agg(
        F.sum("n").alias("request_count"),
        distinct("client_ip", "unique_ips"),
        distinct("path", "unique_paths"),
        F.bool_and("sec_fetch").alias("all_have_sec_fetch"),
        F.bool_and("hints").alias("all_have_hints"),
    )
    samples = first_values(rows, ["asn_org"], "client_ip", sample, "sample_ips")
    joined = groups.join(samples, "asn_org", "left").withColumn("asn_in_name", asn_from_org("asn_org"))
    return joined.orderBy(*largest_first("request_count", ["asn_org"]))


def hosting_human_ips(events: DataFrame, words=rules.ORG_SUSPECT) -> DataFrame:
    """Every address behind :func:`hosting_humans`, one row each."""
    rows = events.where(f"{RESIDENTIAL_HUMAN} and asn_org is not null").where(ilike_any("asn_org", words))
    return rows.groupBy("asn_org", "client_ip").agg(requests("request_count"))


SUSPECT = ("client_ip", "asn_org", "has_sec_fetch_headers", "has_client_hints", "country")


def _suspects(events: DataFrame, words) -> DataFrame:
    return events.where(f"{RESIDENTIAL_HUMAN} and asn_org is not null").where(ilike_any("asn_org", words))


def suspect_evidence(events: DataFrame, value: str = "path", words=rules.ORG_PROXY_SELLERS, limit: int | None = 10) -> DataFrame:
    """Every path, or agent, of the addresses that :func:`suspect_details` lists, one row each."""
    rows = _suspects(events, words)
    listed = top(rows.groupBy(*SUSPECT).agg(requests("request_count")), "request_count", SUSPECT, limit)
    return evidence(rows, listed, SUSPECT, value)


def suspect_details(events: DataFrame, words=rules.ORG_PROXY_SELLERS, limit: int | None = 10) -> DataFrame:
    """Busiest addresses of proxy sellers with paths, agents and rate."""
    found = rank_then_detail(
        _suspects(events, words),
        SUSPECT,
        limit,
        [
            distinct("path", "unique_paths"),
            sorted_values(F.col("path")).alias("all_paths"),
            sorted_values(F.col("user_agent")).alias("user_agents"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        ],
        count="request_count",
    )
    span = seconds_between(F.col("first_seen"), F.col("last_seen"))
    return found.withColumn("duration_seconds", span).withColumn(
        "req_per_sec", req_rate("request_count", "duration_seconds", zero="floor", digits=3)
    )


def _most_common(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Most frequent value per address, the lowest on a tie, from counts (``n``) per value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("client_ip", value).agg(F.sum("n").alias("n"))
    lowest = counts.groupBy("client_ip", "n").agg(F.min(value).alias(value))
    return lowest.groupBy("client_ip").agg(F.max_by(value, "n").alias(name))


def ip_profile(events: DataFrame, ips=DEFAULT.reviewed_ips) -> DataFrame:
    """Fifteen behaviour measures per reviewed address, all addresses in one pass each."""
    rows = events.where(F.col("client_ip").isin(*ips)) if ips is not None else events
    attributes = ("asn_org", "datacenter_provider", "city", "country", "bot_classification", "bot_name")
    # One pass over the events: everything else comes from rows combined per path, site, agent and attributes.
    parts = staged(
        rows.groupBy("client_ip", "path", "site", "user_agent", *attributes).agg(
            requests("n"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            count_where(F.col("has_sec_fetch_headers"), "sec_fetch"),
            count_where(F.col("has_client_hints"), "hints"),
        ),
        "profile",
    )
    profile = parts.groupBy("client_ip").agg(
        F.sum("n").alias("request_count"),
        distinct("path", "unique_paths"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.sum("sec_fetch").alias("has_sec_fetch_count"),
        F.sum("hints").alias("has_client_hints_count"),
        *[F.max(c).alias(c) for c in attributes],
    )
    span = seconds_between(F.col("first_seen"), F.col("last_seen"))
    profile = profile.withColumn("duration_seconds", span)
    profile = profile.join(_most_common(parts, "user_agent", "most_common_ua"), "client_ip", "left")
    profile = profile.join(_most_common(parts, "site", "most_visited_site"), "client_ip", "left")
    return profile.withColumn("requests_per_second", req_rate("request_count", "duration_seconds"))


def ip_verdicts(events: DataFrame, ips=DEFAULT.reviewed_ips) -> DataFrame:
    """Profiles with legitimacy score, verdict and indicators."""
    return legitimacy(ip_profile(events, ips))


def sample_paths(events: DataFrame, ips=DEFAULT.reviewed_ips, n: int = 10) -> DataFrame:
    """First ``n`` distinct paths per reviewed address."""
    rows = events.where(F.col("client_ip").isin(*ips)) if ips is not None else events
    return first_values(rows, ["client_ip"], "path", n, "paths")


VISITOR = ("client_ip", "user_agent", "has_sec_fetch_headers", "has_client_hints", "asn_org", "country")


def too_fast_humans(events: DataFrame, as_of, limit: int | None = 20) -> DataFrame:
    """Visitors of the last 30 days above half a request per second over more than a minute."""
    visitors = (
        since(events.where(RESIDENTIAL_HUMAN), 30 * 24, as_of)
        .groupBy(*VISITOR)
        .agg(
            requests("request_count"),
            distinct("path", "unique_paths"),
            active_seconds().alias("_span"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
        .where("_span > 60 and request_count / _span > 0.5")
        .withColumn("req_per_sec", req_rate("request_count", "_span", digits=3))
        .drop("_span")
    )
    return top(visitors, "req_per_sec", VISITOR, limit)


def path_traversal(events: DataFrame, as_of, limit: int | None = 20) -> DataFrame:
    """Visitors with many paths, or hardly a repeated one. A single request has diversity 1."""
    diversity = F.try_divide("unique_paths", "request_count")
    visitors = (
        since(events.where(RESIDENTIAL_HUMAN), 30 * 24, as_of)
        .groupBy(*VISITOR)
        .agg(requests("request_count"), distinct("path", "unique_paths"))
        .where((F.col("unique_paths") > 50) | (diversity > 0.8))
        .withColumn("path_diversity", fixed_round(diversity, 2))
    )
    return top(visitors, "unique_paths", VISITOR, limit)


def sleepless_humans(events: DataFrame, as_of, limit: int | None = 20) -> DataFrame:
    """Visitors active in more than 18 hours of the day with more than 50 requests in 7 days.

    Agent, owner and country come from the address's earliest human row, which is only looked up
    for the addresses that make the list.
    """
    week = since(events.where(RESIDENTIAL_HUMAN), 7 * 24, as_of)
    hourly = week.groupBy("client_ip", F.hour("timestamp").alias("hour")).agg(requests("requests"))
    active = (
        hourly.groupBy("client_ip")
        .agg(F.count("hour").alias("hours_active"), F.sum("requests").alias("total_requests"))
        .where("hours_active > 18 and total_requests > 50")
        .orderBy(F.col("hours_active").desc(), F.col("total_requests").desc(), "client_ip")
    )
    active = active if limit is None else active.limit(limit)
    first_row = F.struct("timestamp", "id", "user_agent", "asn_org", "country")
    attributes = (
        events.where(HUMAN)
        .join(active, "client_ip")
        .groupBy("client_ip", "hours_active", "total_requests")
        .agg(F.min(first_row).alias("first"))
    )
    return attributes.select(
        "client_ip", "hours_active", "total_requests", "first.user_agent", "first.asn_org", "first.country"
    ).orderBy(F.col("hours_active").desc(), F.col("total_requests").desc(), "client_ip")


def residential_humans(events: DataFrame, as_of) -> DataFrame:
    return since(events.where(RESIDENTIAL_HUMAN), 30 * 24, as_of).agg(requests())


def suspicious_visitors(events: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Rows of the three visitor checks together; with a ``limit`` each listing is cut there first.

    Without a limit nothing is listed: requests are counted by visitor and path and by address and hour in one
    aggregation over one read, the checks hold these counts.
    """
    if limit is not None:
        lists = (
            too_fast_humans(events, as_of, limit).select("client_ip"),
            path_traversal(events, as_of, limit).select("client_ip"),
            sleepless_humans(events, as_of, limit).select("client_ip"),
        )
        return lists[0].unionByName(lists[1]).unionByName(lists[2]).agg(requests("suspicious_count"))
    week = F.col("timestamp") > F.lit(as_timestamp(as_of) - dt.timedelta(days=7))
    rows = since(events.where(RESIDENTIAL_HUMAN), 30 * 24, as_of).select(
        *VISITOR, "path", F.hour("timestamp").alias("hour"), "timestamp", week.alias("in_week")
    )
    by_path, by_hour = [*VISITOR, "path"], ["client_ip", "hour"]
    cells = rows.groupingSets([by_path, by_hour], *by_path, "hour").agg(
        F.grouping("path").alias("hourly"),
        requests("n"),
        F.count_if("in_week").alias("n_week"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    groups = cells.groupBy("hourly", *VISITOR).agg(
        F.sum("n").alias("n"),
        F.sum("n_week").alias("n_week"),
        F.count("path").alias("paths"),
        F.count_if(F.col("n_week") > 0).alias("hours"),
        seconds_between(F.min("first_seen"), F.max("last_seen")).alias("span"),
    )
    per_visitor, per_address = F.col("hourly") == 0, F.col("hourly") == 1
    fast = per_visitor & (F.col("span") > 60) & (F.try_divide("n", "span") > 0.5)
    wandering = per_visitor & ((F.col("paths") > 50) | (F.try_divide("paths", "n") > 0.8))
    sleepless = per_address & F.col("client_ip").isNotNull() & (F.col("hours") > 18) & (F.col("n_week") > 50)
    found = [F.count_if(check) for check in (fast, wandering, sleepless)]
    return groups.agg((found[0] + found[1] + found[2]).alias("suspicious_count"))


def undetermined_patterns(events: DataFrame, cap: int | None = None) -> DataFrame:
    """Undetermined request patterns, the input of the monitoring relabelling; with a ``cap`` the most frequent."""
    return monitoring_candidates(events, cap=cap)

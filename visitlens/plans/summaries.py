"""Whole-table summaries of stored labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import is_attack, traffic_group
from visitlens.functions.metrics import count_where, distinct, fixed_round, percent, requests
from visitlens.operators.filters import between_times, drop_ips
from visitlens.plans.common import largest_first
from visitlens.settings import DEFAULT

CLASS = "bot_classification"


def bot_summary(events: DataFrame) -> DataFrame:
    return (
        events.where("is_bot")
        .groupBy(CLASS)
        .agg(
            requests("total_requests"),
            distinct("client_ip", "unique_ips"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            fixed_round(F.avg("duration"), 4).alias("avg_duration_sec"),
            fixed_round(F.sum("response_size") / 1024 / 1024, 2).alias("total_mb"),
        )
    )


def daily_stats(events: DataFrame) -> DataFrame:
    days = events.groupBy(F.to_date("timestamp").alias("date"), "site", CLASS).agg(
        requests("requests"), distinct("client_ip", "unique_ips")
    )
    return days.orderBy(F.col("date").desc(), *largest_first("requests", ("site", CLASS)))


def class_counts(events: DataFrame) -> DataFrame:
    counts = events.groupBy(CLASS).agg(requests())
    return counts.orderBy(*largest_first("count", [CLASS]))


def class_distribution(events: DataFrame, digits: int = 2, without_ips=()) -> DataFrame:
    """Requests per class with their share of all requests.

    Shares come from a handful of class counts; the grand total is their sum, so the events are
    aggregated once and nothing but one row per class is brought together.
    """
    df = drop_ips(events, without_ips) if without_ips else events
    counts = df.groupBy(CLASS).agg(requests())
    by_class = counts.agg(
        F.sum("count").alias("total"), F.collect_list(F.struct(CLASS, "count")).alias("classes")
    ).select("total", F.inline("classes"))
    return by_class.select(CLASS, "count", percent("count", "total", digits).alias("percentage")).orderBy(
        F.col("count").desc(), F.col(CLASS).asc_nulls_first()
    )


def label_shares(events: DataFrame, ips=DEFAULT.home_ips) -> DataFrame:
    """The distribution printed after a relabelling run: one decimal, review addresses removed."""
    return class_distribution(events, 1, ips)


def metric_rows(events: DataFrame) -> DataFrame:
    """Four totals as (metric, value) rows, from one aggregate."""
    totals = events.agg(
        requests("total"),
        count_where(F.col(CLASS) == "human", "human"),
        count_where(F.col("is_bot"), "bot"),
        count_where(~F.col("has_sec_fetch_headers"), "bare"),
    )
    return totals.selectExpr(
        """stack(4,
            'Total Events', string(total),
            'Human Events', string(human),
            'Bot Events', string(bot),
            'Events Missing Sec-Fetch', string(bare)) as (metric, value)"""
    )


def attack_breakdown(events: DataFrame) -> DataFrame:
    attacks = events.where(is_attack()).groupBy(CLASS).agg(requests(), distinct("client_ip", "unique_ips"))
    return attacks.orderBy(*largest_first("count", [CLASS]))


def human_checks(events: DataFrame) -> DataFrame:
    """Counters that show whether human labels agree with the strict rules."""
    human = F.col(CLASS) == "human"
    return events.agg(
        count_where(human & F.col("has_sec_fetch_headers"), "humans_with_sec_fetch"),
        count_where(human & ~F.col("has_sec_fetch_headers"), "humans_without_sec_fetch"),
        count_where(human & F.col("datacenter_provider").isNotNull(), "humans_from_datacenter"),
    )


def new_providers(events: DataFrame, providers=rules.EXPANDED_PROVIDERS) -> DataFrame:
    """Rows, visitors and owners per newly listed provider.

    Rows are combined per owner and address before they meet in their provider's group. A NULL
    owner is not listed.
    """
    listed = events.where(F.col("datacenter_provider").isin(*providers))
    by_org = listed.groupBy("datacenter_provider", "asn_org", "client_ip").agg(requests("n"))
    counts = by_org.groupBy("datacenter_provider").agg(
        F.sum("n").alias("count"),
        F.count_distinct("client_ip").alias("unique_ips"),
        F.sort_array(F.collect_set("asn_org")).alias("orgs"),
    )
    return counts.orderBy(*largest_first("count", ["datacenter_provider"]))


def group_counts(events: DataFrame) -> DataFrame:
    """Requests per traffic group."""
    return events.groupBy(traffic_group().alias("traffic_group")).agg(requests())


def rows_between(events: DataFrame, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """How many events a time window already holds."""
    return between_times(events, start, end).agg(requests())


def register_views(events: DataFrame) -> None:
    """Publishes the two standing summaries as temporary views for SQL users."""
    bot_summary(events).createOrReplaceTempView("bot_summary")
    daily_stats(events).createOrReplaceTempView("daily_stats")

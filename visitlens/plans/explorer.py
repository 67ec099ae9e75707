"""Explorer reports: ranked groups of a time range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.metrics import count_where, distinct, fixed_round, requests, sorted_values
from visitlens.operators.filters import scope
from visitlens.operators.heavy import heavy_groups
from visitlens.operators.scoring import route_text
from visitlens.plans.common import evidence, rank_then_detail, top
from visitlens.plans.dashboard import class_counts
from visitlens.settings import DEFAULT, Settings

# The network and place reports count labels of either vocabulary; stored data may hold both.
AI_LABELS = {"v1": ("official_ai", "stealth_ai"), "v2": ("ai_official", "ai_stealth")}


def subnet_clusters(
    events: DataFrame, as_of, rng: str = "24h", min_requests: int = 10, settings: Settings = DEFAULT, limit: int | None = 200
) -> DataFrame:
    df = scope(events, rng, as_of, settings).where(F.col("subnet").isNotNull())
    return rank_then_detail(
        df,
        ("subnet", "bot_classification", "datacenter_provider", "asn", "asn_org"),
        limit,
        [distinct("client_ip", "unique_ips"), sorted_values(F.col("country")).alias("countries")],
        count="total_requests",
        at_least=min_requests,
    )


def time_bursts(
    events: DataFrame, as_of, rng: str = "6h", threshold: int = 20, settings: Settings = DEFAULT, limit: int | None = 200
) -> DataFrame:
    """Address-hours with many requests and the paths they asked for.

    The array is for hours with few paths; :func:`burst_paths` has them as rows.
    """
    df = scope(events, rng, as_of, settings).withColumn("time_bucket", F.date_trunc("hour", "timestamp"))
    return rank_then_detail(
        df,
        ("time_bucket", "client_ip", "subnet", "bot_classification", "datacenter_provider"),
        limit,
        [sorted_values(F.col("path")).alias("paths_visited")],
        count="burst_size",
        at_least=threshold,
    )


def burst_paths(
    events: DataFrame, as_of, rng: str = "6h", threshold: int = 20, settings: Settings = DEFAULT, limit: int | None = 200
) -> DataFrame:
    """Every path of the bursts that :func:`time_bursts` lists, one row each."""
    keys = ("time_bucket", "client_ip", "subnet", "bot_classification", "datacenter_provider")
    df = scope(events, rng, as_of, settings).withColumn("time_bucket", F.date_trunc("hour", "timestamp"))
    sizes = df.groupBy(*keys).agg(requests("burst_size")).where(F.col("burst_size") >= threshold)
    return evidence(df, top(sizes, "burst_size", keys, limit), keys, "path")


def datacenter_ips(
    events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, limit: int | None = 200
) -> DataFrame:
    df = scope(events, rng, as_of, settings).where(F.col("datacenter_provider").isNotNull())
    return rank_then_detail(
        df,
        ("client_ip", "datacenter_provider", "asn", "asn_org", "bot_classification", "user_agent"),
        limit,
        [sorted_values(F.col("country")).alias("countries")],
        count="request_count",
    )


def residential_patterns(
    events: DataFrame, as_of, rng: str = "24h", min_requests: int = 10, settings: Settings = DEFAULT, limit: int | None = 200
) -> DataFrame:
    """Subnets without a hosting provider. The class is a key, so the share is 0 or 100."""
    df = scope(events, rng, as_of, settings)
    df = df.where(F.col("datacenter_provider").isNull() & F.col("subnet").isNotNull())
    human = F.when(F.col("bot_classification") == "human", 1.0).otherwise(0.0)
    return rank_then_detail(
        df,
        ("subnet", "country", "bot_classification"),
        limit,
        [distinct("client_ip", "unique_ips"), fixed_round(F.avg(human) * 100, 1).alias("human_percentage")],
        count="request_count",
        at_least=min_requests,
    )


def asn_analysis(
    events: DataFrame, as_of, rng: str = "24h", labels: str = "v1", settings: Settings = DEFAULT, limit: int | None = 100
) -> DataFrame:
    official, hidden = AI_LABELS[labels]
    df = scope(events, rng, as_of, settings).where(F.col("asn").isNotNull())
    return rank_then_detail(
        df,
        ("asn", "asn_org", "datacenter_provider"),
        limit,
        [
            distinct("client_ip", "unique_ips"),
            *class_counts(
                {
                    "human_count": "human",
                    "official_ai_count": official,
                    "stealth_ai_count": hidden,
                    "web_crawler_count": "web_crawler",
                }
            ),
            sorted_values(F.col("country")).alias("countries"),
        ],
        count="total_requests",
    )


_VISITOR = ("client_ip", "subnet", "bot_classification", "country", "city", "datacenter_provider", "asn_org")


def _seen() -> list:
    return [F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")]


def unique_ips(events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, limit: int | None = 500) -> DataFrame:
    groups = scope(events, rng, as_of, settings).groupBy(*_VISITOR).agg(requests("total_requests"), *_seen())
    return top(groups, "total_requests", _VISITOR, limit)


def busiest_ips(events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, limit: int = 500) -> DataFrame:
    """:func:`unique_ips` by summaries: two passes that shuffle candidates only, where a few visitors stand out."""
    return heavy_groups(scope(events, rng, as_of, settings), _VISITOR, limit, _seen(), "total_requests")


def geographic_clusters(
    events: DataFrame,
    as_of,
    rng: str = "24h",
    labels: str = "v1",
    min_requests: int = 10,
    settings: Settings = DEFAULT,
    limit: int | None = 150,
) -> DataFrame:
    df = scope(events, rng, as_of, settings)
    df = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    places = (
        df.groupBy("country", "city")
        .agg(
            fixed_round(F.avg("latitude"), 2).alias("avg_lat"),
            fixed_round(F.avg("longitude"), 2).alias("avg_lng"),
            requests("total_requests"),
            distinct("client_ip", "unique_ips"),
            count_where(F.col("datacenter_provider").isNotNull(), "datacenter_count"),
            *class_counts({"human_count": "human", "stealth_ai_count": AI_LABELS[labels][1]}),
        )
        .where(F.col("total_requests") >= min_requests)
    )
    return top(places, "total_requests", ("country", "city"), limit)


# Reports a routed command can name.
REPORTS: dict[str, Callable[..., DataFrame]] = {
    "unique-ips": unique_ips,
    "subnet-clusters": subnet_clusters,
    "time-bursts": time_bursts,
    "datacenter-ips": datacenter_ips,
    "residential-patterns": residential_patterns,
    "asn-analysis": asn_analysis,
    "geographic-clusters": geographic_clusters,
}


def explore(events: DataFrame, command: str, as_of, **params) -> DataFrame | None:
    """Runs the report a command asks for; None when it names none, see :func:`suggestions`."""
    asked = events.sparkSession.createDataFrame([(command,)], "text string")
    report = route_text(asked).first()["report"]
    return None if report is None else REPORTS[report](events, as_of, **params)


def suggestions() -> list[str]:
    """Commands to offer when one names no report."""
    return [f"show {name.replace('-', ' ')}" for name in REPORTS]

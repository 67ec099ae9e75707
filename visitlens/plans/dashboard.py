"""Dashboard reports over a named time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.labels import display_class, is_attack, norm_site
from visitlens.functions.metrics import (
    bucket_seconds,
    count_where,
    distinct,
    fixed_round,
    percent,
    requests,
    time_bucket,
)
from visitlens.operators.filters import scope
from visitlens.operators.heavy import heavy_groups
from visitlens.operators.scoring import dominant_class
from visitlens.plans.common import largest_first, top
from visitlens.settings import DEFAULT, Settings
from visitlens.streaming.scratch import staged

COUNTED = ("ai_official", "ai_stealth", "web_crawler", "monitoring_service", "bot_undetermined")


def class_counts(names: dict[str, str], column: str = "bot_classification") -> list:
    return [count_where(F.col(column) == label, name) for name, label in names.items()]


def overall_stats(
    events: DataFrame,
    as_of,
    rng: str = "24h",
    settings: Settings = DEFAULT,
    on_topic: bool = False,
    exact: bool = True,
) -> DataFrame:
    """Requests, visitors and requests per class, in one row."""
    return scope(events, rng, as_of, settings, on_topic).agg(
        requests("total_requests"),
        distinct("client_ip", "unique_ips", exact),
        *class_counts({c: c for c in COUNTED}),
        count_where(is_attack(), "attack_traffic"),
        count_where(F.col("bot_classification") == "human", "human"),
    )


def timeline(
    events: DataFrame,
    as_of,
    rng: str = "24h",
    settings: Settings = DEFAULT,
    on_topic: bool = False,
    exact: bool = True,
) -> DataFrame:
    """Visitors per site and time bucket; the bucket width follows the range."""
    df = scope(events, rng, as_of, settings, on_topic).where(F.col("site").isin(*settings.report_hosts))
    bucket = time_bucket("timestamp", bucket_seconds(rng)).alias("time_bucket")
    return df.groupBy(bucket, norm_site().alias("site")).agg(distinct("client_ip", "count", exact))


def filled_timeline(
    events: DataFrame,
    as_of,
    rng: str = "24h",
    settings: Settings = DEFAULT,
    on_topic: bool = False,
) -> DataFrame:
    """Timeline with a row for every site and bucket between the first and last bucket seen.

    No rows come out of an empty range.
    """
    return _filled(timeline(events, as_of, rng, settings, on_topic), rng, settings)


def _filled(counts: DataFrame, rng: str, settings: Settings) -> DataFrame:
    """All counts (a range has few buckets and sites) and their bounds in one row, spread over the calendar."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(bucket_seconds(rng)))
    cell = F.struct("time_bucket", "site")
    one = counts.agg(
        F.min("time_bucket").alias("first"),
        F.max("time_bucket").alias("last"),
        F.map_from_entries(F.collect_list(F.struct(cell, F.col("count")))).alias("cells"),
    ).where("first is not null")
    days = one.select("cells", F.explode(F.sequence(F.col("first"), F.col("last"), step)).alias("time_bucket"))
    grid = days.select("cells", "time_bucket", F.explode(F.array(*map(F.lit, settings.funnel_sites))).alias("site"))
    return grid.select("time_bucket", "site", F.coalesce(F.try_element_at("cells", cell), F.lit(0)).alias("count"))


def classification_breakdown(
    events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, on_topic: bool = False
) -> DataFrame:
    df = scope(events, rng, as_of, settings, on_topic)
    counts = df.groupBy(display_class().alias("name")).agg(requests())
    return counts.orderBy(*largest_first("count", ["name"]))


def top_bots(
    events: DataFrame,
    as_of,
    rng: str = "24h",
    limit: int | None = 10,
    settings: Settings = DEFAULT,
    on_topic: bool = False,
) -> DataFrame:
    named = scope(events, rng, as_of, settings, on_topic).where(F.col("is_bot") & F.col("bot_name").isNotNull())
    return top(named.groupBy(F.col("bot_name").alias("name")).agg(requests()), "count", ["name"], limit)


def busiest_bots(events: DataFrame, as_of, rng: str = "24h", limit: int = 10, settings: Settings = DEFAULT, on_topic: bool = False) -> DataFrame:
    """:func:`top_bots` by summaries, for names so many that counting them all would be a shuffle of its own."""
    named = scope(events, rng, as_of, settings, on_topic).where(F.col("is_bot") & F.col("bot_name").isNotNull())
    return heavy_groups(named.withColumn("name", F.col("bot_name")), ["name"], limit)


def geo_heatmap(
    events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, on_topic: bool = False
) -> DataFrame:
    """Requests per place, coordinates rounded to two decimals."""
    df = scope(events, rng, as_of, settings, on_topic)
    df = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    keys = ("lat", "lng", "country", "city")
    places = df.groupBy(
        fixed_round(F.col("latitude"), 2).alias("lat"),
        fixed_round(F.col("longitude"), 2).alias("lng"),
        "country",
        "city",
    ).agg(
        requests(),
        *class_counts(
            {
                "human_count": "human",
                "official_ai_count": "ai_official",
                "stealth_ai_count": "ai_stealth",
                "web_crawler_count": "web_crawler",
                "monitoring_count": "monitoring_service",
            }
        ),
        count_where(is_attack(), "attack_count"),
    )
    return places.orderBy(*largest_first("count", keys))


def coloured_heatmap(
    events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT, on_topic: bool = False
) -> DataFrame:
    """Heat map with the class each place is coloured by."""
    return dominant_class(geo_heatmap(events, as_of, rng, settings, on_topic))


def traffic_shares(stats: DataFrame) -> DataFrame:
    """Share of traffic per class from a row of overall statistics, one decimal."""
    shares = {
        "human_pct": "human",
        "ai_official_pct": "ai_official",
        "ai_stealth_pct": "ai_stealth",
        "web_crawler_pct": "web_crawler",
        "monitoring_pct": "monitoring_service",
        "undetermined_pct": "bot_undetermined",
        "attack_pct": "attack_traffic",
    }
    return stats.select(
        "total_requests",
        "unique_ips",
        *[percent(c, "total_requests", 1).alias(name) for name, c in shares.items()],
    )


def dashboard(events: DataFrame, as_of, rng: str = "24h", settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """The four frames of the front page, without the topic filter, from one pass over the events."""
    df = scope(events, rng, as_of, settings)
    bucket = time_bucket("timestamp", bucket_seconds(rng)).alias("time_bucket")
    cells = staged(df.groupBy(bucket, "site", "client_ip", "bot_classification", "bot_name", "is_bot").agg(requests("n")), "dashboard")

    def rows(condition, name: str):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    named = cells.where(F.col("is_bot") & F.col("bot_name").isNotNull())
    counts = cells.where(F.col("site").isin(*settings.report_hosts)).groupBy("time_bucket", norm_site().alias("site"))
    classes = cells.groupBy(display_class().alias("name")).agg(F.sum("n").alias("count"))
    label = F.col("bot_classification")
    return {
        "stats": cells.agg(
            rows(F.lit(True), "total_requests"),
            distinct("client_ip", "unique_ips"),
            *[rows(label == c, c) for c in COUNTED],
            rows(is_attack(), "attack_traffic"),
            rows(label == "human", "human"),
        ),
        "timeline": _filled(counts.agg(distinct("client_ip", "count")), rng, settings),
        "bot_classification": classes.orderBy(*largest_first("count", ["name"])),
        "top_bots": top(named.groupBy(F.col("bot_name").alias("name")).agg(F.sum("n").alias("count")), "count", ["name"], 10),
    }

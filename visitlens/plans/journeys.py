"""Visitor journeys, behaviour patterns and raw event access.

The tables for patterns and journeys are declared by their columns only; thresholds follow the
training-agent and burst rules, and the confidence formula is this library's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import funnel_stage, norm_site
from visitlens.functions.metrics import requests
from visitlens.operators.bursts import peaks
from visitlens.operators.filters import in_range
from visitlens.settings import DEFAULT, Settings
from visitlens.streaming.scratch import staged

HARVEST_PATHS = 50
HARVEST_DIVERSITY = 0.8


def journey_sites(events: DataFrame) -> DataFrame:
    """Every site of every subnet with its requests, one row each."""
    rows = events.where("subnet is not null").withColumn("site", norm_site())
    return rows.groupBy("subnet", "site").agg(requests())


def journeys(events: DataFrame, settings: Settings = DEFAULT, all_sites: bool = True) -> DataFrame:
    """One journey per subnet: sites in order of name, furthest stage, totals and usual label.

    ``all_sites=False`` lists the funnel's sites only; :func:`journey_sites` has all of them as rows.

    A row per (subnet, site, address, label) is counted first, so a busy subnet reaches its group
    as distinct combinations rather than as events. Subnets outside the funnel have no journey.
    """
    rows = events.where("subnet is not null").withColumn("site", norm_site())
    # One pass over the events; the rest is worked out from the combined rows.
    parts = staged(
        rows.groupBy("subnet", "site", "client_ip", "bot_classification", "bot_name").agg(
            requests("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
        ),
        "journeys",
    )
    visitors = (
        parts.select("subnet", "client_ip")
        .distinct()
        .groupBy("subnet")
        .agg(F.count("client_ip").alias("unique_ips"), F.min("client_ip").alias("_ip"))
    )
    # The host of a request is the client's choice, so only the funnel's own sites go into the array.
    funnel_site = F.when(F.col("site").isin(*settings.funnel_sites), F.col("site"))
    totals = parts.groupBy("subnet").agg(
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.sort_array(F.collect_set("site" if all_sites else funnel_site)).alias("sites_visited"),
        F.sum("n").alias("total_requests"),
    )
    usual = _usual_label(parts)
    stage = funnel_stage("sites_visited", settings)
    journey = totals.join(visitors, "subnet").join(usual, "subnet", "left").withColumn("funnel_stage", stage)
    return journey.where("funnel_stage >= 1").select(
        "subnet",
        F.when(F.col("unique_ips") == 1, F.col("_ip")).alias("client_ip"),
        "first_seen",
        "last_seen",
        "sites_visited",
        "funnel_stage",
        (F.col("funnel_stage") == 3).alias("completed_funnel"),
        "total_requests",
        "unique_ips",
        "bot_classification",
        "bot_name",
    )


def _usual_label(parts: DataFrame) -> DataFrame:
    """Most frequent (class, name) per subnet, the lowest pair on a tie."""
    pair = F.struct("bot_classification", "bot_name")
    counts = parts.groupBy("subnet", "bot_classification", "bot_name").agg(F.sum("n").alias("n"))
    lowest = counts.groupBy("subnet", "n").agg(F.min(pair).alias("label"))
    return lowest.groupBy("subnet").agg(F.max_by("label", "n").alias("label")).select("subnet", "label.*")


def funnel(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Journeys per furthest stage."""
    stages = journeys(events, settings, all_sites=False).groupBy("funnel_stage")
    return stages.agg(requests("journeys"), F.sum("unique_ips").alias("unique_ips")).orderBy("funnel_stage")


def pattern_evidence(events: DataFrame) -> DataFrame:
    """Every site and path of every address with its requests; joined with the patterns on the address."""
    rows = events.withColumn("site", norm_site()).where("client_ip is not null")
    return rows.groupBy("client_ip", "site", "path").agg(requests())


def behavior_patterns(events: DataFrame, settings: Settings = DEFAULT, as_of=None, arrays: bool = False) -> DataFrame:
    """Addresses that look automated, one row per address and pattern.

    ``rapid_sequential``: above 0.5 requests per second, or more than 20 requests in any 2 minutes of a stay; the most
    requests in 2 minutes are ``peak_requests``.
    ``data_harvesting``: more than 50 paths, or over 80 % distinct paths in at least 20 requests.
    ``cross_site_journey``: at least two funnel sites.
    :func:`pattern_evidence` has the sites and paths as rows. ``arrays`` puts the distinct ones of the flagged
    addresses into arrays, for addresses with few of them.
    """
    rows = events.withColumn("site", norm_site()).where("client_ip is not null")
    per_path = staged(
        rows.groupBy("client_ip", "subnet", "site", "path").agg(
            requests("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
        ),
        "patterns",
    )
    span = (F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / 1e6
    per_ip = per_path.groupBy("client_ip").agg(
        F.min("subnet").alias("subnet"),
        F.sum("n").alias("request_count"),
        span.alias("span"),
        F.max("last").alias("last"),
        F.count_distinct("path").alias("paths"),
        F.count_distinct(F.when(F.col("site").isin(*settings.funnel_sites), F.col("site"))).alias("stages"),
    )
    bursts = staged(peaks(events, rules.BURST_SECONDS), "peaks").select("client_ip", F.col("peak").alias("peak_requests"))
    per_ip = per_ip.join(bursts, "client_ip", "left")
    n = F.col("request_count")
    rate = F.coalesce(F.try_divide(n, F.col("span")), F.lit(0.0))
    diversity = F.col("paths") / n
    rapid = (rate > rules.HUMAN_MAX_RATE) | (F.coalesce(F.col("peak_requests"), F.lit(0)) > rules.BURST_REQUESTS)
    harvesting = (F.col("paths") > HARVEST_PATHS) | ((diversity > HARVEST_DIVERSITY) & (n >= rules.BURST_REQUESTS))

    def pattern(condition, name: str, confidence, suggested):
        capped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
        value = F.struct(
            F.lit(name).alias("pattern_type"),
            F.round(capped, 4).alias("confidence_score"),
            F.lit(suggested).cast("string").alias("suggested_classification"),
        )
        return F.when(condition, value)

    found = F.array_compact(
        F.array(
            pattern(rapid, "rapid_sequential", 0.5 + rate / 2, "ai_stealth"),
            pattern(harvesting, "data_harvesting", diversity, "ai_stealth"),
            pattern(F.col("stages") >= 2, "cross_site_journey", F.col("stages") / 3, None),
        )
    )
    flagged = per_ip.withColumn("_found", found).where(F.size("_found") > 0)
    listed = []
    if arrays:
        listed = ["sites_visited", "paths_accessed"]
        values = [F.sort_array(F.collect_set(c)).alias(name) for c, name in zip(("site", "path"), listed, strict=True)]
        of_flagged = per_path.join(flagged.select("client_ip"), "client_ip", "left_semi")
        flagged = flagged.join(of_flagged.groupBy("client_ip").agg(*values), "client_ip")
    detected = F.col("last") if as_of is None else F.lit(as_of).cast("timestamp")
    return flagged.withColumn("_pattern", F.explode("_found")).select(
        detected.alias("detected_at"),
        "client_ip",
        "subnet",
        "_pattern.pattern_type",
        "_pattern.confidence_score",
        "request_count",
        "peak_requests",
        F.floor("span").alias("time_span_seconds"),
        *listed,
        "_pattern.suggested_classification",
    )


def query_events(
    events: DataFrame,
    rng: str | None = None,
    as_of=None,
    limit: int | None = None,
    **equals,
) -> DataFrame:
    """Raw events by column values and time range, newest first when a limit is asked for."""
    df = events if rng is None else in_range(events, rng, as_of)
    for column, value in equals.items():
        df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df if limit is None else df.orderBy(F.col("timestamp").desc(), "id").limit(limit)

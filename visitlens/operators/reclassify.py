"""Relabelling runs. Each returns a change set for :mod:`visitlens.operators.changes`.

A change set has ``id``, with ``event_date`` and ``timestamp`` for events of the stored table,
``old_class``, ``new_class`` and the columns the run writes, which differ from run to run. The set-based runs leave ``is_bot``
untouched unless ``fix_is_bot`` is given.

Rules about an address are aggregated once per address and joined back, so an address that owns a
large share of the traffic is pre-aggregated on the map side and never gathered in one task.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import ilike_any, no_agent, provider_of
from visitlens.functions.metrics import seconds_between
from visitlens.operators.classify import classify_v2
from visitlens.operators.enrich import enrich_asn
from visitlens.operators.filters import as_timestamp, drop_ips
from visitlens.operators.skew import spread_join
from visitlens.settings import DEFAULT

PATTERN_KEYS = (
    "client_ip",
    "user_agent",
    "path",
    "datacenter_provider",
    "has_sec_fetch_headers",
    "has_client_hints",
)


def _is(label: str) -> Column:
    return F.col("bot_classification") == label


def _changed(df: DataFrame, new_class: Column, written: dict[str, Column], fix_is_bot: bool = False) -> DataFrame:
    if fix_is_bot:
        written = {**written, "is_bot": new_class != "human"}
    keys = ["id", "event_date", "timestamp"] if "event_date" in df.columns else ["id"]
    return df.select(
        *keys,
        F.col("bot_classification").alias("old_class"),
        new_class.alias("new_class"),
        *[value.alias(name) for name, value in written.items()],
    )


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


@dataclass(frozen=True)
class RowJob:
    """A run that looks at the row alone: what it reads, the rows it changes, and the columns it writes."""

    rows: DataFrame
    hit: Column
    label: Column
    written: dict[str, Column]

    def changes(self) -> DataFrame:
        return _changed(self.rows.where(self.hit), self.label, self.written)

    def applied(self, columns) -> DataFrame:
        """The rows with the written columns replaced where the run changes them: a projection, no join."""
        hit = F.coalesce(self.hit, F.lit(False))
        new = {c: F.when(hit, value).otherwise(F.col(c)).alias(c) for c, value in self.written.items() if c in columns}
        return self.rows.select(*[new.get(c, F.col(c)) for c in columns])


def _full_rerun(events: DataFrame) -> RowJob:
    df = classify_v2(events, headers="flags")
    label, name = F.col("cls.bot_classification"), F.col("cls.bot_name")
    hit = _differs(label, F.col("bot_classification")) | _differs(name, F.col("bot_name"))
    written = {c: F.col(f"cls.{c}") for c in ("bot_classification", "bot_name", "detection_level", "is_bot")}
    return RowJob(df, hit, label, written)


def full_rerun(events: DataFrame) -> DataFrame:
    """Current rules over every stored event; rows whose label or name changes."""
    return _full_rerun(events).changes()


def _undetermined_rerun(events: DataFrame, ips=DEFAULT.excluded_ips) -> RowJob:
    df = classify_v2(events, headers="flags")
    label = F.col("cls.bot_classification")
    hit = _is("bot_undetermined") & ~F.col("client_ip").isin(*ips) & _differs(label, F.col("bot_classification"))
    return RowJob(df, hit, label, {"bot_classification": label, "bot_name": F.col("cls.bot_name"), "is_bot": label != "human"})


def undetermined_rerun(events: DataFrame, ips=DEFAULT.excluded_ips) -> DataFrame:
    return _undetermined_rerun(drop_ips(events.where(_is("bot_undetermined")), ips), ips).changes()


def training_agents(events: DataFrame, fix_is_bot: bool = False) -> DataFrame:
    """Human rows of hosting addresses that sent a browser-like or an empty agent without Sec-Fetch.

    An address seen under several providers is named after the smallest.
    """
    ua, provider = F.col("user_agent"), F.col("datacenter_provider")
    sec_fetch_off = F.coalesce(~F.col("has_sec_fetch_headers"), F.lit(False))
    posing = (
        ua.ilike("%Mozilla%")
        & ilike_any(ua, ("Chrome", "Safari", "Firefox"))
        & ~ilike_any(ua, ("bot", "crawler", "spider"))
        & sec_fetch_off
    )
    hosted = events.where(_is("human") & provider.isNotNull())
    # Counting per (address, provider) first leaves few strings to take the smallest of.
    by_provider = hosted.groupBy("client_ip", "datacenter_provider").agg(
        F.count_if(posing | no_agent()).alias("_candidates"), F.count_if(sec_fetch_off).alias("_rows")
    )
    per_ip = (
        by_provider.groupBy("client_ip")
        .agg(F.min(F.when(F.col("_candidates") > 0, provider)).alias("_provider"), F.sum("_rows").alias("_rows"))
        .where("_provider is not null")
    )
    df = spread_join(hosted.where(sec_fetch_off), per_ip, "client_ip", "_rows", "inner")
    return _changed(
        df,
        F.lit("ai_training"),
        {
            "bot_classification": F.lit("ai_training"),
            "bot_name": F.concat(F.upper("_provider"), F.lit("-Training-Agent")),
            "detection_level": F.lit(3),
        },
        fix_is_bot,
    )


def monitoring_candidates(events: DataFrame, ips=DEFAULT.home_ips, cap: int | None = None) -> DataFrame:
    """Request patterns among undetermined rows, all of them or the ``cap`` most frequent."""
    patterns = (
        drop_ips(events.where(_is("bot_undetermined")), ips)
        .groupBy(*PATTERN_KEYS)
        .agg(F.count(F.lit(1)).alias("request_count"))
    )
    if cap is None:
        return patterns
    return patterns.orderBy(F.col("request_count").desc(), *[F.col(k).asc_nulls_first() for k in PATTERN_KEYS]).limit(cap)


def as_monitoring(
    events: DataFrame, ips=DEFAULT.home_ips, cap: int | None = None, fix_is_bot: bool = False
) -> DataFrame:
    """Undetermined rows the current rules call monitoring; with a ``cap``, of the most frequent patterns only.

    The rules only look at the pattern's own columns, so without a cap no join is needed.
    """
    df = drop_ips(events.where(_is("bot_undetermined")), ips)
    if cap is None:
        return _as_monitoring(df, ips, fix_is_bot).changes()
    else:
        top = classify_v2(monitoring_candidates(events, ips, cap), headers="flags")
        top = top.where(F.col("cls.bot_classification") == "monitoring_service")
        top = top.select(*[F.col(k).alias(f"_{k}") for k in PATTERN_KEYS])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PATTERN_KEYS]
        df = df.join(top, same, "left_semi")
    label = F.lit("monitoring_service")
    return _changed(df, label, {"bot_classification": label}, fix_is_bot)


def _as_monitoring(events: DataFrame, ips=DEFAULT.home_ips, fix_is_bot: bool = False) -> RowJob:
    label = F.lit("monitoring_service")
    hit = _is("bot_undetermined") & ~F.col("client_ip").isin(*ips) & (F.col("cls.bot_classification") == label)
    written = {"bot_classification": label} | ({"is_bot": F.lit(True)} if fix_is_bot else {})
    return RowJob(classify_v2(events, headers="flags"), hit, label, written)


def human_patterns(events: DataFrame, as_of: dt.datetime | str, fix_is_bot: bool = False) -> DataFrame:
    """Six ordered rules over human rows, each seeing the labels the earlier ones left.

    1. cheap hosting companies, 2. burst addresses of the last 7 days, 3. short VPN sessions,
    4. one cloud company, 5. corporate proxies, 6. remaining hosting addresses with 3+ rows.

    Rules 1 and 4 look at the row alone. Rules 2, 3, 5 and 6 claim every remaining human row of an
    address, so the rows a later rule sees are those of unclaimed addresses minus the row rules
    before it. That makes one aggregation per address enough for all of them.
    """
    org, provider, ts, ip = F.col("asn_org"), F.col("datacenter_provider"), F.col("timestamp"), F.col("client_ip")
    week_ago = F.lit(as_timestamp(as_of) - dt.timedelta(days=7))
    now = F.lit(as_timestamp(as_of))

    cheap = F.coalesce(ilike_any(org, rules.ORG_CHEAP_HOSTS), F.lit(False))
    tencent = F.coalesce(org.ilike("%Tencent%"), F.lit(False))
    corporate = ilike_any(org, (rules.ORG_CORPORATE_LIKE,)) | org.isin(*rules.ORG_CORPORATE_EXACT)
    subsets = {
        "burst": ~cheap & (ts > week_ago) & (ts <= now),
        "warp": ~cheap & (org == rules.ORG_WARP) & ip.startswith(rules.WARP_PREFIX),
        "corp": ~cheap & ~tencent & corporate,
    }

    human = events.where(_is("human"))
    partial = [F.count(F.lit(1)).alias("_rows"), F.count_if(~cheap & ~tencent).alias("left_n")]
    for name, rows in subsets.items():
        partial += [
            F.count_if(rows).alias(f"{name}_n"),
            F.min(F.when(rows, ts)).alias(f"{name}_from"),
            F.max(F.when(rows, ts)).alias(f"{name}_to"),
        ]
    by_provider = human.groupBy("client_ip", "datacenter_provider").agg(*partial)
    merged = [
        F.sum("_rows").alias("_rows"),
        F.min(F.when(F.col("left_n") >= 3, provider)).alias("_provider"),
    ]
    for name in subsets:
        merged += [
            F.sum(f"{name}_n").alias(f"{name}_n"),
            seconds_between(F.min(f"{name}_from"), F.max(f"{name}_to")).alias(f"{name}_s"),
        ]
    n, s = (lambda k: F.col(f"{k}_n")), (lambda k: F.col(f"{k}_s"))
    burst = (n("burst") >= 5) & (s("burst") > 0) & (F.try_divide(n("burst"), s("burst")) > 0.2)
    warp = n("warp").between(1, 19) & (s("warp") < 3600)
    corp = (n("corp") >= 5) & (s("corp") < 300)
    rule = (
        F.when(burst, "burst")
        .when(warp, "warp")
        .when(corp, "corp")
        .when(F.col("_provider").isNotNull(), "stealth")
    )
    per_ip = (
        by_provider.groupBy("client_ip")
        .agg(*merged)
        .select("client_ip", "_rows", "_provider", rule.alias("_rule"))
        .where("_rule is not null")
    )

    df = spread_join(human, per_ip, "client_ip", "_rows", "left")
    hit = F.col("_rule")
    step = (
        F.when(cheap, "cheap")
        .when(hit.isin("burst", "warp"), hit)
        .when(tencent, "tencent")
        .otherwise(hit)
    )
    df = df.withColumn("_step", step).where("_step is not null")
    step = F.col("_step")
    label = F.when(step == "corp", "web_crawler").otherwise("stealth_ai")
    name = (
        F.when(step == "cheap", "Cheap-Hosting-Scraper")
        .when(step == "burst", "Burst-Pattern-Bot")
        .when(step == "warp", "Cloudflare-WARP-Bot")
        .when(step == "tencent", "Tencent-Cloud-Bot")
        .when(step == "corp", "Corporate-Proxy-Crawler")
        .otherwise(F.concat(F.upper("_provider"), F.lit("-Stealth")))
    )
    level = F.when(step == "burst", 3).otherwise(2)
    return _changed(df, label, {"bot_classification": label, "bot_name": name, "detection_level": level}, fix_is_bot)


def _hosting_networks(events: DataFrame, asns=rules.NEW_HOSTING_ASNS) -> RowJob:
    stored = F.col("datacenter_provider")
    missing = F.coalesce(stored, F.lit("")) == ""
    rerun = classify_v2(
        events.withColumn("_stored", stored).withColumn("datacenter_provider", F.lit("hosting")), headers="flags"
    ).withColumn("datacenter_provider", F.col("_stored"))
    label = F.when(_is("human"), F.col("cls.bot_classification")).otherwise(F.col("bot_classification"))
    relabelled = _differs(label, F.col("bot_classification"))
    written = {
        "datacenter_provider": F.when(missing, "hosting").otherwise(stored),
        "bot_classification": label,
        "is_bot": F.when(relabelled, label != "human").otherwise(F.col("is_bot")),
    }
    return RowJob(rerun, F.col("asn").isin(*asns) & (missing | relabelled), label, written)


def hosting_networks(events: DataFrame, asns=rules.NEW_HOSTING_ASNS) -> DataFrame:
    """Marks newly listed networks as hosting and re-runs their human rows under that provider."""
    return _hosting_networks(events.where(F.col("asn").isin(*asns)), asns).changes()


# Runs that can also be applied as projections.
ROW_JOBS = {
    "full_rerun": _full_rerun,
    "undetermined_rerun": _undetermined_rerun,
    "as_monitoring": _as_monitoring,
    "hosting_networks": _hosting_networks,
}


def applied(events: DataFrame, job: str, *args, **kwargs) -> DataFrame:
    """Events after one of ``ROW_JOBS``: one pass over the rows, without a change set and without a join."""
    return ROW_JOBS[job](events, *args, **kwargs).applied(events.columns)


def expanded_networks(
    events: DataFrame, networks: DataFrame | None = None, extra: dict[int, str] | None = None
) -> DataFrame:
    """Finds the provider of events stored without one and re-runs the unsure labels among them.

    The network comes from the stored columns, or is looked up again when ``networks`` is given.
    """
    todo = events.where(F.col("datacenter_provider").isNull() & F.col("asn").isNotNull())
    if networks is None:
        todo = todo.withColumn("datacenter_provider", provider_of("asn", "asn_org", extra))
    else:
        todo = enrich_asn(todo.drop("asn", "asn_org", "datacenter_provider"), networks, extra)
    found = classify_v2(todo.where(F.col("datacenter_provider").isNotNull()), headers="flags")
    unsure = F.coalesce(F.col("bot_classification").isin("human", "bot_undetermined"), F.lit(False))
    changed = unsure & _differs(F.col("cls.bot_classification"), F.col("bot_classification"))

    def pick(column: str) -> Column:
        return F.when(changed, F.col(f"cls.{column}")).otherwise(F.col(column))

    return _changed(
        found,
        pick("bot_classification"),
        {
            "datacenter_provider": F.col("datacenter_provider"),
            **{c: pick(c) for c in ("bot_classification", "bot_name", "detection_level", "is_bot")},
        },
    )

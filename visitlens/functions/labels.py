"""Column expressions over stored labels, agents, organisations and sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.matching import fold, matches_any
from visitlens.settings import DEFAULT, Settings


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words) -> Column:
    return either(c.contains(w) for w in words)


def ilike_any(c: Column | str, words) -> Column:
    """Case-insensitive substring test for any of the words."""
    c = col(c)
    return either(c.ilike(f"%{w}%") for w in words)


def no_agent(ua: Column | str = "user_agent") -> Column:
    return F.coalesce(col(ua), F.lit("")) == ""


def attack_class(path: Column) -> Column:
    """Attack label of a path, NULL when it looks harmless."""
    uri = fold(path)
    # The terms are the rarer and cheaper test.
    shell = contains_any(uri, rules.SHELL_TERMS) & matches_any(uri, rules.SHELL_PATHS)
    return (
        F.when(matches_any(uri, rules.CMS_PATHS), "attack_wordpress_scanner")
        .when(shell, "attack_webshell_scanner")
        .when(matches_any(uri, rules.CONFIG_PATHS), "attack_config_scanner")
        .when(matches_any(uri, rules.EXPLOIT_PATHS), "attack_exploit_attempt")
    )


def is_attack(label: Column | str = "bot_classification") -> Column:
    """``LIKE`` with the underscore acting as a one-character wildcard."""
    return col(label).like("attack_%")


def norm_site(site: Column | str = "site") -> Column:
    """Removes ``www.`` wherever it occurs."""
    return F.replace(col(site), F.lit("www."), F.lit(""))


def display_class(label: Column | str = "bot_classification") -> Column:
    c = col(label)
    return (
        F.when(c == "human", "Human")
        .when(c == "ai_official", "Official AI")
        .when(c == "ai_stealth", "Stealth AI")
        .when(c == "web_crawler", "Web Crawler")
        .when(c == "monitoring_service", "Monitoring")
        .when(c == "bot_undetermined", "Undetermined Bot")
        .when(is_attack(c), "Attack Traffic")
        .otherwise("Unknown")
    )


def map_labels(label: Column | str = "bot_classification") -> Column:
    """First-generation label to its successor; ``human`` and crawlers need a re-run instead."""
    c = col(label)
    return (
        F.when(c == "official_ai", "ai_official")
        .when(c.isin("stealth_ai", "ai_training"), "ai_stealth")
        .otherwise(c)
    )


def traffic_group(label: Column | str = "bot_classification") -> Column:
    c = col(label)
    return (
        F.when(c == "human", "Human Traffic")
        .when(c.isin("ai_official", "ai_stealth"), "AI Bots")
        .when(c == "web_crawler", "Web Crawlers")
        .when(is_attack(c), "Attack Traffic")
        .otherwise("Unknown")
    )


def ua_family(ua: Column | str = "user_agent") -> Column:
    c = col(ua)

    def has(word: str) -> Column:
        return c.ilike(f"%{word}%")

    return (
        F.when(no_agent(c), "No User-Agent")
        .when(has("Chrome") & has("Safari"), "Chrome-like")
        .when(has("Firefox"), "Firefox-like")
        .when(has("Safari") & ~has("Chrome"), "Safari-like")
        .when(has("Edge"), "Edge-like")
        .when(has("curl"), "curl")
        .when(has("wget"), "wget")
        .when(has("python"), "Python")
        .when(has("java"), "Java")
        .when(has("okhttp"), "OkHttp")
        .when(has("go-http"), "Go HTTP Client")
        .otherwise("Other")
    )


def undetermined_reason() -> Column:
    sec_fetch, provider = F.col("has_sec_fetch_headers"), F.col("datacenter_provider")
    return (
        F.when(no_agent(), "No User-Agent")
        .when(~sec_fetch & provider.isNull(), "Missing Sec-Fetch (residential)")
        .when(~sec_fetch & provider.isNotNull(), "Missing Sec-Fetch (datacenter)")
        .when(~F.col("has_client_hints") & sec_fetch, "Has Sec-Fetch but no Client Hints")
        .otherwise("Other reasons")
    )


def org_category(org: Column | str, requests: Column | str, ips: Column | str) -> Column:
    name = F.lower(col(org))
    return (
        F.when(contains_any(name, rules.ORG_MAJOR_CLOUD), "major_cloud")
        .when(contains_any(name, rules.ORG_CDN), "cdn_proxy")
        .when(contains_any(name, rules.ORG_TELECOM) & contains_any(name, rules.ORG_TELECOM_CLOUD), "telecom_cloud")
        .when(contains_any(name, rules.ORG_HOSTING), "hosting_vps")
        .when((col(requests) > 50) & (col(ips) > 10), "suspicious")
    )


def suggest_provider(category: Column | str, org: Column | str) -> Column:
    """Provider label to add to the network map, by review category."""
    name, category = F.lower(col(org)), col(category)

    def first_word(words, default: str) -> Column:
        return F.coalesce(*[F.when(name.contains(w), w) for w in words], F.lit(default))

    return (
        F.when(category == "major_cloud", first_word(rules.ORG_MAJOR_CLOUD, "unknown"))
        .when(category == "cdn_proxy", first_word(rules.ORG_CDN[:3], "cdn"))
        .when(category == "telecom_cloud", "telecom-cloud")
    )


def asn_from_org(org: Column | str) -> Column:
    """Network number written as ``AS<digits>`` in an organisation name."""
    return F.nullif(F.regexp_extract(col(org), r"AS(\d+)", 1), F.lit(""))


def funnel_stage(sites: Column | str, settings: Settings = DEFAULT) -> Column:
    """3, 2 or 1 for the furthest funnel site in an array of sites, 0 for none."""
    sites = col(sites)
    first, second, third = settings.funnel_sites
    return (
        F.when(F.array_contains(sites, third), 3)
        .when(F.array_contains(sites, second), 2)
        .when(F.array_contains(sites, first), 1)
        .otherwise(0)
    )


def provider_of(asn: Column | str, org: Column | str, extra: dict[int, str] | None = None) -> Column:
    """Hosting provider of a network: the explicit map first, then whole words in the name.

    The map holds a few dozen literal entries, so it is an expression rather than a join.
    """
    known = {**rules.DATACENTER_ASNS, **(extra or {})}
    pairs = [F.lit(x) for item in known.items() for x in item]
    by_number = F.try_element_at(F.create_map(*pairs), col(asn).cast("int"))
    return F.coalesce(by_number, F.when(col(org).rlike(rules.whole_words(rules.HOSTING_WORDS)), "hosting"))

"""Request labels as one ``CASE`` of structs per generation of the rules.

``Signals`` names the facts a rule may look at. They come either from the header bag or from the
flags a stored event keeps; the cascade itself does not know which.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import attack_class, contains_any, no_agent
from visitlens.functions.matching import first_match, fold, matches, matches_any
from visitlens.functions.requests import first_value, has_any_header
from visitlens.operators.once import computed_once

# Working column: the agent folded once per row.
AGENT = "_agent"
VERDICT_FIELDS = ("is_bot", "bot_classification", "bot_name", "detection_level", "detection_reason")

ATTACKS = {
    "attack_wordpress_scanner": ("WordPress-Scanner", "WordPress vulnerability scanning"),
    "attack_webshell_scanner": ("WebShell-Scanner", "Web shell / backdoor scanning"),
    "attack_config_scanner": ("Config-Scanner", "Configuration file / database scanner"),
    "attack_exploit_attempt": ("Exploit-Scanner", "Active exploit attempt detected"),
}


@dataclass(frozen=True)
class Signals:
    ua: Column
    agent: Column  # folded ``ua``
    path: Column
    provider: Column
    sec_fetch: Column
    sec_fetch_site: Column
    client_hints: Column
    accepts_html: Column
    driver_header: Column
    bot_header: Column
    request_count: Column
    span_seconds: Column


def _stats(df_columns) -> tuple[Column, Column]:
    if {"request_count", "span_seconds"} <= set(df_columns):
        return F.col("request_count"), F.col("span_seconds")
    return F.lit(None).cast("long"), F.lit(None).cast("double")


def signals_from_headers(columns, headers: str = "headers") -> Signals:
    count, span = _stats(columns)
    accept = first_value("Accept", headers)
    return Signals(
        ua=F.col("user_agent"),
        agent=F.col(AGENT),
        path=F.col("path"),
        provider=F.nullif(F.col("datacenter_provider"), F.lit("")),
        sec_fetch=has_any_header(rules.SEC_FETCH, headers),
        sec_fetch_site=first_value("Sec-Fetch-Site", headers).isNotNull(),
        client_hints=has_any_header(rules.CLIENT_HINTS, headers),
        accepts_html=F.coalesce(accept.contains("text/html"), F.lit(False)),
        driver_header=has_any_header((rules.DEVTOOLS_HEADER, rules.WEBDRIVER_HEADER), headers),
        bot_header=has_any_header(("From", "X-Openai-Host-Hash", "X-Request-Id"), headers)
        | F.coalesce(matches_any(fold(first_value("User-Agent", headers)), ("bot", "crawler")), F.lit(False)),
        request_count=count,
        span_seconds=span,
    )


def signals_from_flags(columns) -> Signals:
    """Signals of a stored event: two flags stand for the headers, the rest is absent."""
    count, span = _stats(columns)
    sec_fetch = F.coalesce(F.col("has_sec_fetch_headers"), F.lit(False))
    never = F.lit(False)
    return Signals(
        ua=F.col("user_agent"),
        agent=F.col(AGENT),
        path=F.col("path"),
        provider=F.nullif(F.col("datacenter_provider"), F.lit("")),
        sec_fetch=sec_fetch,
        sec_fetch_site=sec_fetch,
        client_hints=F.coalesce(F.col("has_client_hints"), F.lit(False)),
        accepts_html=never,
        driver_header=never,
        bot_header=never,
        request_count=count,
        span_seconds=span,
    )


def verdict(is_bot: bool, label, name, level, reason) -> Column:
    def text(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        F.lit(is_bot).alias("is_bot"),
        text(label).alias("bot_classification"),
        text(name).alias("bot_name"),
        F.lit(level).cast("int").alias("detection_level"),
        text(reason).alias("detection_reason"),
    )


def official_ai(agent: Column, names=rules.AI_AGENTS) -> Column:
    return first_match(agent, [(n, n) for n in names])


def headless_agent(ua: Column, agent: Column) -> Column:
    return matches_any(agent, rules.HEADLESS) | ua.contains("webdriver")


def is_headless(s: Signals) -> Column:
    """Needs an agent: a driver header alone does not count."""
    return F.coalesce((s.ua != "") & (headless_agent(s.ua, s.agent) | s.driver_header), F.lit(False))


def is_human(s: Signals) -> Column:
    rate = F.try_divide(s.request_count, s.span_seconds)
    too_fast = F.coalesce((s.span_seconds > 0) & (rate > rules.HUMAN_MAX_RATE), F.lit(False))
    return s.sec_fetch & (s.client_hints | s.accepts_html) & s.provider.isNull() & ~is_headless(s) & ~too_fast


def crawler(ua: Column, agent: Column) -> Column:
    """Name of a declared, headless or generic crawler."""
    return F.coalesce(
        first_match(agent, rules.CRAWLERS),
        F.when(headless_agent(ua, agent), "Headless-Browser"),
        F.when(matches_any(agent, rules.GENERIC_CRAWLER), "Generic-Crawler"),
    )


def monitor_by_agent(agent: Column) -> Column:
    return first_match(agent, rules.MONITORS)


def hostname_challenge(s: Signals) -> Column:
    return F.coalesce(s.path.contains(rules.HOSTNAME_CHALLENGE_PATH), F.lit(False)) | F.coalesce(
        matches(s.agent, rules.HOSTNAME_CHALLENGE_AGENT), F.lit(False)
    )


def monitor_by_behaviour(s: Signals) -> Column:
    return s.provider.isNotNull() & no_agent(s.ua) & s.path.isin(*rules.ROOT_PATHS)


def dc_crawler(s: Signals) -> Column:
    short_agent = F.coalesce(F.length(s.ua), F.lit(0)) <= rules.SHORT_AGENT_CHARS
    return s.provider.isNotNull() & short_agent & (s.path != "") & ~s.path.isin(*rules.ROOT_PATHS)


def browser_agent(ua: Column) -> Column:
    return ua.contains("Mozilla") & contains_any(ua, rules.BROWSER_ENGINES)


def stealth(s: Signals) -> Column:
    return s.provider.isNotNull() & browser_agent(s.ua) & ~s.sec_fetch


def undetermined_text(s: Signals) -> Column:
    facts = F.concat_ws(
        ", ",
        F.when(no_agent(s.ua), "No User-Agent"),
        F.concat(F.lit("Datacenter: "), s.provider),
        F.when(~s.sec_fetch_site, "Missing Sec-Fetch headers"),
    )
    return F.coalesce(F.nullif(facts, F.lit("")), F.lit("Failed human verification checks"))


def stages(s: Signals) -> dict[str, Column]:
    """Working columns of the cascade, in order; each looks only at rows no earlier one claimed.

    One column per family keeps every generated method small enough for the JVM to compile.
    """
    return {
        "_human": F.when(is_human(s), "human"),
        "_attack": attack_class(s.path),
        "_ai": official_ai(s.agent),
        "_crawler": crawler(s.ua, s.agent),
        "_monitor": monitor_by_agent(s.agent),
    }


def verdict_v2(s: Signals) -> Column:
    """The cascade, over the columns of :func:`stages`."""
    attack, ai, crawl, monitor = (F.col(c) for c in ("_attack", "_ai", "_crawler", "_monitor"))
    upper = F.upper(s.provider)

    result = F.when(F.col("_human").isNotNull(), verdict(False, "human", None, None, "Passed all human verification checks"))
    attack_name = F.lit(None).cast("string")
    attack_reason = F.lit(None).cast("string")
    for label, (name, reason) in ATTACKS.items():
        attack_name = F.when(attack == label, name).otherwise(attack_name)
        attack_reason = F.when(attack == label, reason).otherwise(attack_reason)
    crawl_reason = (
        F.when(crawl == "Headless-Browser", "Headless browser automation detected")
        .when(crawl == "Generic-Crawler", "Generic bot/crawler pattern in User-Agent")
        .otherwise("Traditional web crawler")
    )
    return (
        result.when(attack.isNotNull(), verdict(True, attack, attack_name, 1, attack_reason))
        .when(ai.isNotNull(), verdict(True, "ai_official", ai, 1, "Official AI bot declared in User-Agent"))
        .when(crawl.isNotNull(), verdict(True, "web_crawler", crawl, 1, crawl_reason))
        .when(monitor.isNotNull(), verdict(True, "monitoring_service", monitor, 2, "Uptime/monitoring service"))
        .when(
            hostname_challenge(s),
            verdict(True, "monitoring_service", "Cloudflare-Verify", 2, "Cloudflare custom hostname verification"),
        )
        .when(
            monitor_by_behaviour(s),
            verdict(
                True,
                "monitoring_service",
                F.concat(upper, F.lit("-Monitor")),
                2,
                F.concat(s.provider, F.lit(" availability check (no UA, simple path)")),
            ),
        )
        .when(
            dc_crawler(s),
            verdict(
                True,
                "ai_stealth",
                F.concat(upper, F.lit("-Crawler")),
                2,
                F.concat(s.provider, F.lit(" datacenter + no UA + content path (systematic crawling)")),
            ),
        )
        .when(
            stealth(s),
            verdict(
                True,
                "ai_stealth",
                F.concat(upper, F.lit("-Stealth-AI")),
                2,
                "Datacenter + browser UA + missing Sec-Fetch headers",
            ),
        )
        .otherwise(verdict(True, "bot_undetermined", "Undetermined-Bot", 3, undetermined_text(s)))
    )


def stages_v1(s: Signals) -> dict[str, Column]:
    generic = F.when(matches_any(s.agent, rules.GENERIC_CRAWLER), "Generic-Bot")
    return {
        "_ai": official_ai(s.agent, rules.AI_AGENTS_V1),
        "_crawler": F.coalesce(first_match(s.agent, rules.CRAWLERS_V1), generic),
    }


def verdict_v1(s: Signals) -> Column:
    """First generation: agent, then network, then behaviour, else human."""
    ai, crawl = F.col("_ai"), F.col("_crawler")
    browser = (
        s.agent.contains("mozilla")
        & matches_any(s.agent, rules.BROWSER_ENGINES)
        & ~matches_any(s.agent, rules.BOT_WORDS)
    )
    upper = F.upper(s.provider)
    rate = F.when(s.span_seconds > 0, F.try_divide(s.request_count, s.span_seconds)).otherwise(F.lit(0.0))
    burst = (rate > rules.HUMAN_MAX_RATE) | (
        (s.span_seconds < rules.BURST_SECONDS) & (s.request_count > rules.BURST_REQUESTS)
    )
    seconds = F.when(
        s.span_seconds == F.floor(s.span_seconds), s.span_seconds.cast("long").cast("string")
    ).otherwise(s.span_seconds.cast("string"))
    per_second = F.floor(rate * 100 + 0.5) / 100
    burst_reason = F.format_string("Burst pattern: %d req in %ss (%.2f/sec)", s.request_count, seconds, per_second)
    training_name = F.concat(upper, F.lit("-Training-Agent"))
    trains = s.provider.isNotNull() & browser & ~s.sec_fetch
    return (
        F.when(ai.isNotNull(), verdict(True, "official_ai", ai, 1, None))
        .when(crawl.isNotNull(), verdict(True, "web_crawler", crawl, 1, None))
        .when(
            s.provider.isNotNull() & browser & ~s.bot_header,
            verdict(True, "stealth_ai", F.concat(upper, F.lit("-Stealth")), 2, None),
        )
        .when(
            trains,
            verdict(
                True,
                "ai_training",
                training_name,
                3,
                F.when(burst, burst_reason).otherwise("Datacenter IP + browser UA + missing Sec-Fetch headers"),
            ),
        )
        .otherwise(verdict(False, "human", None, None, None))
    )


def _classify(df: DataFrame, s: Signals, families: dict[str, Column], label: Column, into: str) -> DataFrame:
    df = df.withColumn(AGENT, fold(s.ua))
    open_rows = F.lit(True)
    for name, found in families.items():
        df = df.withColumn(name, F.when(open_rows, found))
        open_rows = open_rows & F.col(name).isNull()
    return computed_once(df, into, label).drop(AGENT, *families)


def _signals(df: DataFrame, headers: str) -> Signals:
    return signals_from_flags(df.columns) if headers == "flags" else signals_from_headers(df.columns, headers)


def classify_v2(df: DataFrame, path_aware: bool = True, headers: str = "headers", into: str = "cls") -> DataFrame:
    """Adds the current label as a struct column.

    ``headers`` names the header bag, or is ``"flags"`` to read the two stored flags.
    ``path_aware=False`` hides the path from the rules, as first-time ingestion does. Session
    columns ``request_count`` and ``span_seconds`` are used when present.
    """
    s = _signals(df, headers)
    if not path_aware:
        s = replace(s, path=F.lit(None).cast("string"))
    return _classify(df, s, stages(s), verdict_v2(s), into)


def classify_v1(df: DataFrame, headers: str = "headers", into: str = "cls") -> DataFrame:
    s = _signals(df, headers)
    return _classify(df, s, stages_v1(s), verdict_v1(s), into)


def unpack(df: DataFrame, cls: str = "cls") -> DataFrame:
    """Replaces the struct by its five columns, overwriting stored labels of the same name."""
    keep = [c for c in df.columns if c not in (*VERDICT_FIELDS, cls)]
    return df.select(*keep, f"{cls}.*")

"""The rule tables against expectations written out here: for each rule one hit and one near miss."""

import pytest
from pyspark.sql import functions as F

from tests.test_classify import frame
from visitlens.functions.labels import provider_of
from visitlens.functions.matching import first_match, fold, matches, matches_any
from visitlens.functions.rules import MONITORS
from visitlens.operators.classify import classify_v2, unpack
from visitlens.operators.filters import drop_scanners

# What the rules are meant to say.
AGENTS = {
    "GPTBot": ("Mozilla/5.0 GPTBot/1.2", "GPT Bt/1.2"),
    "OAI-SearchBot": ("OAI-SearchBot/1.0", "OAI SearchBt"),
    "ChatGPT-User": ("ChatGPT-User/1.0", "ChatGPT User"),
    "ClaudeBot": ("ClaudeBot/1.0", "Claude Bt"),
    "Claude-Web": ("Claude-Web/1.0", "Claude Web"),
    "Google-Extended": ("Google-Extended", "Google Extended"),
    "Gemini-Deep-Research": ("Gemini-Deep-Research", "Gemini Deep Research"),
    "GoogleAgent-Mariner": ("GoogleAgent-Mariner", "GoogleAgent Mariner"),
    "PerplexityBot": ("perplexitybot/1.0", "Perplexity Bt"),
    "Meta-ExternalAgent": ("meta-externalagent/1.1", "Meta-External Agent"),
    "Meta-ExternalFetcher": ("meta-externalfetcher/1.1", "Meta-External Fetcher"),
    "Amazonbot": ("Amazonbot/0.1", "Amazon Bt"),
    "Applebot-Extended": ("Applebot-Extended/0.1", "Apple Extended"),
    "Bytespider": ("Bytespider", "Byte Spidr"),
    "YouBot": ("YouBot", "You Bt"),
}
CRAWLERS = {
    "Googlebot": ("Googlebot/2.1", "Google-bt"),
    "Bingbot": ("bingbot/2.0", "bing-bt"),
    "Yahoo-Slurp": ("Yahoo! Slurp", "Slurp Yahoo"),
    "DuckDuckBot": ("DuckDuckBot/1.1", "DuckDuck"),
    "Baiduspider": ("Baiduspider/2.0", "Baidu"),
    "YandexBot": ("YandexBot/3.0", "Yandex"),
    "Sogou": ("Sogou web", "Sogu web"),
    "Exabot": ("Exabot/3.0", "Exa"),
    "facebookexternalhit": ("facebookexternalhit/1.1", "facebookexternal"),
    "Twitterbot": ("Twitterbot/1.0", "Twitter"),
    "LinkedInBot": ("LinkedInBot/1.0", "LinkedIn"),
    "Slackbot": ("Slackbot 1.0", "Slack"),
    "Discordbot": ("Discordbot/2.0", "Discord"),
    "WhatsApp": ("WhatsApp/2.0", "Whats App"),
    "TelegramBot": ("TelegramBot", "Telegram"),
    "Applebot": ("Applebot/0.1", "Apple"),
}
MONITORED = {
    "Cloudflare-Verify": ("Cloudflare Custom Verification", "Verification Cloudflare"),
    "Cloudflare-Health": ("Cloudflare-Healthchecks", "Health of Cloudflare"),
    "UptimeRobot": ("UptimeRobot/2.0", "Uptime Robot"),
    "Pingdom": ("Pingdom.com_bot", "Pingdm"),
    "StatusCake": ("StatusCake", "Status Cake"),
    "Site24x7": ("Site24x7", "Site 24x7"),
    "Uptime.com": ("Uptime.com", "Uptime-com"),
    "Freshping": ("FreshPing", "Fresh ping"),
    "Monitor": ("Monitoring agent", "A Monitor"),
    "Uptime-Check": ("my uptime check", "check uptime"),
    "Availability-Check": ("availability-check", "check availability"),
}
SCANNED = {
    "/wp-admin/x": "/a/wp-admin", "/wordpress/wp-admin": "/a/wordpress", "/wp/": "/wp", "/a/wp-login.php": "/a/wp-login",
    "/xmlrpc.php": "/xmlrpc", "/a/wp-config": "/a/wpconfig", "/setup-config.php": "/setup-config", "/wp-content/plugins": "/wp-content/x",
    "/wp-includes/x": "/wp-include", "/wp-json/wp/v2/users": "/wp-json/wp/v2/posts", "/readme.html": "/readme.html2",
    "/license.txt": "/license.txt2", "/wp-cron.php": "/wp-cron", "/?author=1": "/author=1", "/wp-sitemap.xml": "/sitemap.xml",
    "/debug.log": "/debug", "/.env": "/env", "/phpMyAdmin": "/php-my-admin", "/pma/": "/pma", "/dbadmin": "/db-admin",
    "/sqladmin": "/sql-admin", "/mysqladmin": "/my-sql-admin", "/.git/x": "/git", "/.svn": "/svn", "/a.bak": "/a.bak2",
    "/a.backup": "/a.backups", "/a.old": "/a.older", "/a.save": "/a.saved", "/a.orig": "/a.origin", "/a.swp": "/a.swap", "/a~": "/~a",
}
PROVIDERS = {
    8075: "azure", 15169: "gcp", 396982: "gcp", 16509: "aws", 14618: "aws", 13335: "cloudflare", 132892: "cloudflare", 16276: "ovh",
    14061: "digitalocean", 20473: "vultr", 63949: "linode", 24940: "hetzner", 132203: "tencent", 45090: "tencent", 45102: "alibaba",
    37963: "alibaba", 136907: "huawei", 55967: "baidu", 134756: "telecom-cloud", 59223: "telecom-cloud", 9009: "hosting", 64267: "hosting",
    8076: None, 15170: None, 1: None,
}


@pytest.mark.parametrize(("table", "label"), [(AGENTS, "ai_official"), (CRAWLERS, "web_crawler")])
def test_agents(spark, table, label):
    cases = [(hit, "/a", {}, None) for hit, _ in table.values()] + [(miss, "/a", {}, None) for _, miss in table.values()]
    got = {r.n: r for r in unpack(classify_v2(frame(spark, cases))).collect()}
    for i, name in enumerate(table):
        assert (got[i].bot_classification, got[i].bot_name) == (label, name)
        assert got[i + len(table)].bot_name != name


def test_monitors(spark):
    rows = [(hit, name) for name, (hit, _) in MONITORED.items()] + [(miss, None) for _, miss in MONITORED.values()]
    df = spark.createDataFrame(rows, "ua string, want string").withColumn("got", first_match(fold(F.col("ua")), MONITORS))
    assert [r for r in df.collect() if r.got != r.want] == []
    assert {name for name, _ in MONITORS} == set(MONITORED)


def test_scanner_uris(spark):
    rows = [(*uri.split("?", 1), None)[:2] for pair in SCANNED.items() for uri in pair]
    df = spark.createDataFrame(rows, "path string, query_string string")
    kept = {r.path for r in drop_scanners(df).collect()}
    assert kept == {uri.split("?")[0] for uri in SCANNED.values()}


def test_providers_of_networks(spark):
    df = spark.createDataFrame(list(PROVIDERS.items()), "asn int, want string").withColumn("org", F.lit("Plain Company"))
    got = df.withColumn("got", provider_of("asn", "org")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_alternatives_are_stated_apart(spark):
    with pytest.raises(ValueError):
        matches(F.lit("b"), "a|b")
    folded = spark.createDataFrame([("xb",), ("(a|b)",), ("q",)], "t string").select(fold(F.col("t")).alias("t"))
    assert [r[0] for r in folded.select(matches_any(F.col("t"), ["x(a|b)", r"\(a\|b\)", "[|]z"])).collect()] == [True, True, False]

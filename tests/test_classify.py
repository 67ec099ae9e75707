"""Golden label cases and one case per rule."""

import pytest
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import attack_class, provider_of
from visitlens.functions.matching import fold, matches
from visitlens.operators.classify import classify_v1, classify_v2, unpack

CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
HEADLESS = CHROME.replace("Chrome/", "HeadlessChrome/")
BROWSER = {"Sec-Fetch-Site": "none", "Sec-Fetch-Mode": "navigate", "Sec-Ch-Ua": '"Chrome"', "Accept": "text/html,*/*"}
SCHEMA = "n int, user_agent string, path string, headers map<string,array<string>>, datacenter_provider string"

# (agent, path, headers, provider) -> (class, name, level, reason)
V2 = [
    (CHROME, None, BROWSER, None, "human", None, None, "Passed all human verification checks"),
    (HEADLESS, None, {"Sec-Fetch-Site": "none"}, None, "web_crawler", "Headless-Browser", 1, None),
    ("Mozilla/5.0 (compatible; GPTBot/1.2)", None, {}, None, "ai_official", "GPTBot", 1, None),
    (CHROME, None, {}, "azure", "ai_stealth", "AZURE-Stealth-AI", 2, None),
    ("curl/7.68.0", "/wp-admin/admin.php", {}, None, "attack_wordpress_scanner", "WordPress-Scanner", 1, None),
    (None, "/alfa.php", {}, "azure", "attack_webshell_scanner", "WebShell-Scanner", 1, None),
    ("Mozilla/5.0 (compatible; Googlebot/2.1)", None, {}, None, "web_crawler", "Googlebot", 1, None),
    (None, None, {}, "azure", "bot_undetermined", "Undetermined-Bot", 3, "No User-Agent, Datacenter: azure, Missing Sec-Fetch headers"),
    (CHROME, None, {}, None, "bot_undetermined", "Undetermined-Bot", 3, "Missing Sec-Fetch headers"),
    # the generic word "bot" comes before the monitor list
    ("UptimeRobot/2.0", "/", {}, None, "web_crawler", "Generic-Crawler", 1, None),
    ("StatusCake", "/", {}, None, "monitoring_service", "StatusCake", 2, None),
    ("Monitoring agent", "/", {}, None, "monitoring_service", "Monitor", 2, None),
    ("my Monitor", "/", {}, None, "bot_undetermined", "Undetermined-Bot", 3, None),
    ("", "/", {}, "aws", "monitoring_service", "AWS-Monitor", 2, "aws availability check (no UA, simple path)"),
    ("", "/page.html", {}, "aws", "ai_stealth", "AWS-Crawler", 2, None),
    ("x" * 50, "/page.html", {}, "aws", "ai_stealth", "AWS-Crawler", 2, None),
    ("x" * 51, "/page.html", {}, "aws", "bot_undetermined", "Undetermined-Bot", 3, None),
    ("Applebot/0.1", None, {}, None, "web_crawler", "Applebot", 1, None),
    ("Applebot-Extended/0.1", None, {}, None, "ai_official", "Applebot-Extended", 1, None),
    ("Reader (see http example)", None, {}, None, "web_crawler", "Generic-Crawler", 1, None),
    ("Cloudflare Custom Hostname", None, {}, None, "monitoring_service", "Cloudflare-Verify", 2, "Cloudflare custom hostname verification"),
    ("x", "/.well-known/cf-custom-hostname-challenge/7", {}, None, "monitoring_service", "Cloudflare-Verify", 2, None),
    # client hints may be replaced by an html accept header, and a provider rules humans out
    (CHROME, None, {"Sec-Fetch-Dest": "document", "Accept": "text/html"}, None, "human", None, None, None),
    (CHROME, None, {"Sec-Fetch-Dest": "document", "Accept": "*/*"}, None, "bot_undetermined", "Undetermined-Bot", 3, "Missing Sec-Fetch headers"),
    (CHROME, None, BROWSER, "gcp", "bot_undetermined", "Undetermined-Bot", 3, "Datacenter: gcp"),
    (CHROME, None, {**BROWSER, "Webdriver": "1"}, None, "bot_undetermined", "Undetermined-Bot", 3, "Failed human verification checks"),
    # an empty agent escapes the headless test
    ("", None, {**BROWSER, "Webdriver": "1"}, None, "human", None, None, None),
    # an empty header value counts as missing
    (CHROME, None, {**BROWSER, "Sec-Fetch-Site": "", "Sec-Fetch-Mode": ""}, None, "bot_undetermined", "Undetermined-Bot", 3, None),
]


def frame(spark, cases):
    rows = [(i, c[0], c[1], {k: [v] for k, v in c[2].items()}, c[3]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, SCHEMA)


def test_v2_cases(spark):
    got = {r.n: r for r in unpack(classify_v2(frame(spark, V2))).collect()}
    for i, case in enumerate(V2):
        label, name, level, reason = case[4:]
        r = got[i]
        assert (r.bot_classification, r.bot_name, r.detection_level) == (label, name, level), (i, case)
        assert r.is_bot == (label != "human")
        if reason:
            assert r.detection_reason == reason, (i, case)


def test_pathless_rules_never_see_the_path(spark):
    df = unpack(classify_v2(frame(spark, V2), path_aware=False))
    got = {r.n: r.bot_classification for r in df.collect()}
    assert got[4] == "web_crawler" and got[5] == "bot_undetermined"
    assert got[13] == got[14] == "bot_undetermined"
    assert not any(c.startswith("attack_") for c in got.values())


def test_fast_sessions_are_not_human(spark):
    df = frame(spark, V2[:1]).crossJoin(
        spark.createDataFrame([(10, 10.0), (5, 10.0), (9, 0.0), (None, None)], "request_count long, span_seconds double")
    )
    got = {(r.request_count, r.bot_classification) for r in unpack(classify_v2(df)).collect()}
    assert got == {(10, "bot_undetermined"), (5, "human"), (9, "human"), (None, "human")}


def test_v1_cases(spark):
    cases = [
        ("x GPTBot/1.2", None, {"From": "a@b"}, None, "official_ai", "GPTBot", 1),
        ("x ClaudeBot/1.0", None, {}, None, "official_ai", "ClaudeBot", 1),
        (CHROME, None, {}, "azure", "stealth_ai", "AZURE-Stealth", 2),
        (CHROME, None, {}, "gcp", "stealth_ai", "GCP-Stealth", 2),
        (CHROME, None, {"Sec-Fetch-Site": "same-origin"}, None, "human", None, None),
        ("Yahoo! Slurp", None, {}, None, "web_crawler", "Yahoo", 1),
        ("Applebot/0.1", None, {}, None, "web_crawler", "Generic-Bot", 1),
        ("Perplexity-User/1", None, {}, None, "official_ai", "Perplexity-User", 1),
        (CHROME, None, {"X-Request-Id": "1"}, "azure", "ai_training", "AZURE-Training-Agent", 3),
        (CHROME, None, {"From": "a", "Sec-Fetch-Site": "none"}, "azure", "human", None, None),
        (None, None, {}, "azure", "human", None, None),
    ]
    got = {r.n: r for r in unpack(classify_v1(frame(spark, cases))).collect()}
    for i, case in enumerate(cases):
        assert (got[i].bot_classification, got[i].bot_name, got[i].detection_level) == case[4:], case


def test_v1_burst_reason(spark):
    df = frame(spark, [(CHROME, None, {"From": "a"}, "azure")])
    df = df.withColumn("request_count", F.lit(5).cast("long")).withColumn("span_seconds", F.lit(8.0))
    assert unpack(classify_v1(df)).first().detection_reason == "Burst pattern: 5 req in 8s (0.63/sec)"


ATTACKS = {
    "attack_wordpress_scanner": [
        "/WP-Admin", "/wp-login.php", "/wp/x", "/a/wp-config.bak", "/xmlrpc.php", "/wp-json/wp/v2/users",
        "/a/wp-content/themes", "/a/wp-includes/x", "/wp-cron.php", "/readme.html", "/license.txt",
    ],
    "attack_webshell_scanner": ["/alfa.php", "/c99.PHP", "/shell.php", "/cmd.php", "/x/alfacgiapi", "/lock360.php", "/function.php", "/admin/upload.php"],
    "attack_config_scanner": ["/.env", "/config.yml", "/.git/HEAD", "/.svn", "/PhpMyAdmin", "/pma/", "/dbadmin", "/sqladmin", "/mysqladmin"],
    "attack_exploit_attempt": ["/../x", "/..\\x", "/<script>", "/union all select", "/eval(1)", "/base64_decode", "/system(", "/exec(", "/passthru("],
    None: ["/", "/a/wp-admin", "/wp", "/readme.html\n", "/readme.htmlx", "/page.php", "/admin.php", "/upload.php", "/config", "/git", "/..x", "/shell", None],
}


def test_attack_paths(spark):
    rows = [(p, label) for label, paths in ATTACKS.items() for p in paths]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", attack_class(F.col("path")))
    assert [r for r in df.collect() if r.got != r.want] == []


FAMILIES = (
    rules.AI_AGENTS + rules.CMS_PATHS + rules.SHELL_PATHS + rules.CONFIG_PATHS + rules.EXPLOIT_PATHS + rules.SCANNER_URIS
    + rules.HEADLESS + rules.GENERIC_CRAWLER + tuple(p for _, p in rules.CRAWLERS + rules.MONITORS)
)


def test_string_tests_agree_with_the_regular_expressions(spark):
    texts = [p for paths in ATTACKS.values() for p in paths if p] + [c[0] for c in V2 if c[0]]
    texts += ["xYahoo! now Slurp", "Applebot", "Applebot-Extended", "uptime  CHECK", "a.bak", "a.bakx", "x~", "x~y", "", "é\nMonitor", "Monitor"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", fold(F.col("t")))
    wrong = [F.when(matches(F.col("f"), p) != F.col("t").rlike("(?i)" + p), p) for p in FAMILIES]
    assert df.select("t", F.array_compact(F.array(*wrong)).alias("w")).where("size(w) > 0").collect() == []


def test_kelvin_sign_does_not_fold(spark):
    df = spark.createDataFrame([("SlacKbot",), ("SLACKBOT",)], "t string")
    assert [r[0] for r in df.select(matches(fold(F.col("t")), "Slackbot")).collect()] == [False, True]


@pytest.mark.parametrize(
    "asn, org, want",
    [
        (8075, "anything", "azure"),
        (64500, "Some Cloud Ltd", "hosting"),
        (64500, "Écloud SA", "hosting"),  # the edge is an ASCII word edge
        (64500, "Cloudy Ltd", None),
        (64500, "my_cloud", None),
        (9009, "M247", "hosting"),
        (None, None, None),
        (16276, "OVH Hosting", "ovh"),  # the number wins
    ],
)
def test_provider(spark, asn, org, want):
    df = spark.createDataFrame([(asn, org)], "asn int, org string")
    assert df.select(provider_of("asn", "org")).first()[0] == want


def test_added_network_wins(spark):
    df = spark.createDataFrame([(8075,), (64999,)], "asn int").withColumn("org", F.lit(None).cast("string"))
    extra = {8075: "mine", 64999: "lab"}
    assert [r[0] for r in df.select(provider_of("asn", "org", extra)).collect()] == ["mine", "lab"]


def test_strict_rules_leave_no_doubtful_humans(spark):
    from visitlens.plans.summaries import human_checks
    from visitlens.sources.bindings import web_events

    df = unpack(classify_v2(web_events(spark, "/root/testdata/sf0.001"), headers="flags"))
    row = human_checks(df).first()
    assert row.humans_with_sec_fetch > 0
    assert (row.humans_without_sec_fetch, row.humans_from_datacenter) == (0, 0)

"""Rule tables as data. Everything in this module is a fixed value the labels are defined by.

Patterns are case-insensitive Java regular expressions; :mod:`visitlens.functions.matching` turns
them into column tests.
"""

from __future__ import annotations

from collections.abc import Iterable

# --- Fixed values: declared AI agents, first match wins -------------------------------------------
AI_AGENTS = (
    "GPTBot",
    "OAI-SearchBot",
    "ChatGPT-User",
    "ClaudeBot",
    "Claude-Web",
    "Google-Extended",
    "Gemini-Deep-Research",
    "GoogleAgent-Mariner",
    "PerplexityBot",
    "Meta-ExternalAgent",
    "Meta-ExternalFetcher",
    "Amazonbot",
    "Applebot-Extended",
    "Bytespider",
    "YouBot",
)

# The first-generation list has two more agents.
AI_AGENTS_V1 = (
    "GPTBot",
    "OAI-SearchBot",
    "ChatGPT-User",
    "ClaudeBot",
    "Claude-Web",
    "Google-Extended",
    "Gemini-Deep-Research",
    "GoogleAgent-Mariner",
    "PerplexityBot",
    "Perplexity-User",
    "Meta-ExternalAgent",
    "Meta-ExternalFetcher",
    "Amazonbot",
    "MistralAI-User",
    "Applebot-Extended",
    "Bytespider",
    "YouBot",
)

# --- Fixed values: named crawlers as (name, pattern) ----------------------------------------------
CRAWLERS = (
    ("Googlebot", "Googlebot"),
    ("Bingbot", "bingbot"),
    ("Yahoo-Slurp", "Yahoo.*Slurp"),
    ("DuckDuckBot", "DuckDuckBot"),
    ("Baiduspider", "Baiduspider"),
    ("YandexBot", "YandexBot"),
    ("Sogou", "Sogou"),
    ("Exabot", "Exabot"),
    ("facebookexternalhit", "facebookexternalhit"),
    ("Twitterbot", "Twitterbot"),
    ("LinkedInBot", "LinkedInBot"),
    ("Slackbot", "Slackbot"),
    ("Discordbot", "Discordbot"),
    ("WhatsApp", "WhatsApp"),
    ("TelegramBot", "TelegramBot"),
    ("Applebot", "Applebot(?!-Extended)"),
)
# First generation: no Applebot, and another name for the third one.
CRAWLERS_V1 = tuple(("Yahoo" if n == "Yahoo-Slurp" else n, p) for n, p in CRAWLERS if n != "Applebot")

GENERIC_CRAWLER = ("bot", "crawler", "spider", "scraper", "curl", "wget", "python", "java", "http")
BOT_WORDS = ("bot", "crawler", "spider", "scraper")

# --- Fixed values: uptime and availability monitors -----------------------------------------------
MONITORS = (
    ("Cloudflare-Verify", "Cloudflare.*Verification"),
    ("Cloudflare-Health", "Cloudflare.*Health"),
    ("UptimeRobot", "UptimeRobot"),
    ("Pingdom", "Pingdom"),
    ("StatusCake", "StatusCake"),
    ("Site24x7", "Site24x7"),
    ("Uptime.com", r"Uptime\.com"),
    ("Freshping", "Freshping"),
    ("Monitor", "^Monitor"),
    ("Uptime-Check", "uptime.*check"),
    ("Availability-Check", "availability.*check"),
)
HOSTNAME_CHALLENGE_PATH = ".well-known/cf-custom-hostname-challenge"
HOSTNAME_CHALLENGE_AGENT = "Cloudflare.*Custom.*Hostname"
ROOT_PATHS = ("/", "/robots.txt", "/favicon.ico", "/index.html", "/sitemap.xml")

# --- Fixed values: headless and browser agents ----------------------------------------------------
HEADLESS = ("HeadlessChrome", "Puppeteer", "Playwright", "Selenium", "PhantomJS", "SlimerJS", "electron")
BROWSER_ENGINES = ("Chrome", "Safari", "Firefox", "Edge")
SHORT_AGENT_CHARS = 50
HUMAN_MAX_RATE = 0.5
BURST_SECONDS = 120
BURST_REQUESTS = 20

# --- Fixed values: attack paths -------------------------------------------------------------------
CMS_PATHS = (
    "^/wp-admin",
    "^/wp-login",
    "^/wp/",
    "wp-config",
    r"xmlrpc\.php",
    "wp-json/wp/v2/users",
    "/wp-content/(plugins|themes)",
    "/wp-includes/",
    r"wp-cron\.php",
    r"readme\.html\z",
    r"license\.txt\z",
)
SHELL_PATHS = (
    r"\.(php|asp|aspx|jsp)\z",
    r"alfa\.php",
    r"c99\.php",
    r"shell\.php",
    r"cmd\.php",
    r"admin\.php",
    r"upload\.php",
    "ALFA_DATA",
    "alfacgiapi",
)
# Searched in the lower-cased path, so the upper-case term never hits; kept for completeness.
SHELL_TERMS = (
    "alfa",
    "c99",
    "shell",
    "cmd",
    "admin/upload",
    "ALFA_DATA",
    "alfacgiapi",
    "lock360",
    "function.php",
)
CONFIG_PATHS = (
    r"/\.env",
    r"/config\.(php|json|yml|yaml)",
    r"/\.git",
    r"/\.svn",
    "phpmyadmin",
    "/pma/",
    "dbadmin",
    "sqladmin",
    "mysqladmin",
)
EXPLOIT_PATHS = (
    r"\.\.(/|\\)",
    "<script>",
    "union.*select",
    r"eval\(",
    "base64_decode",
    r"system\(",
    r"exec\(",
    r"passthru\(",
)
# First generation: plain prefixes.
EXPLOIT_PREFIXES_V1 = (
    "/wp-admin",
    "/wp-login",
    "/xmlrpc.php",
    "/.env",
    "/config.php",
    "/phpmyadmin",
    "/.git",
    "/admin",
    "/administrator",
)

# --- Fixed values: scanner traffic dropped at ingestion (tested on path and query) ----------------
SCANNER_URIS = (
    "^/wp-admin",
    "^/wordpress/wp-admin",
    "^/wp/",
    r"wp-login\.php",
    r"xmlrpc\.php",
    "wp-config",
    r"setup-config\.php",
    "/wp-content/(plugins|themes)",
    "/wp-includes/",
    "wp-json/wp/v2/users",
    r"readme\.html\z",
    r"license\.txt\z",
    r"wp-cron\.php",
    r"\?author=",
    "wp-sitemap",
    r"debug\.log",
    r"/\.env",
    "phpmyadmin",
    "/pma/",
    "/dbadmin",
    "sqladmin",
    "mysqladmin",
    r"/\.git",
    r"/\.svn",
    r"\.(bak|backup|old|save|orig|swp)\z",
    r"~\z",
)

# --- Fixed values: request headers ----------------------------------------------------------------
SEC_FETCH = ("Sec-Fetch-Site", "Sec-Fetch-Mode", "Sec-Fetch-Dest")
SEC_FETCH_STORED = ("Sec-Fetch-Site", "Sec-Fetch-Mode", "Sec-Fetch-Dest", "Sec-Fetch-User")
CLIENT_HINTS = ("Sec-Ch-Ua", "Sec-Ch-Ua-Mobile", "Sec-Ch-Ua-Platform")
DEVTOOLS_HEADER = "X-DevTools-Emulate-Network-Conditions-Client-Id"
WEBDRIVER_HEADER = "Webdriver"

# --- Fixed values: network numbers of hosting companies -------------------------------------------
DATACENTER_ASNS = {
    8075: "azure",
    15169: "gcp",
    396982: "gcp",
    16509: "aws",
    14618: "aws",
    13335: "cloudflare",
    132892: "cloudflare",
    16276: "ovh",
    14061: "digitalocean",
    20473: "vultr",
    63949: "linode",
    24940: "hetzner",
    132203: "tencent",
    45090: "tencent",
    45102: "alibaba",
    37963: "alibaba",
    136907: "huawei",
    55967: "baidu",
    134756: "telecom-cloud",
    59223: "telecom-cloud",
    134768: "telecom-cloud",
    23724: "telecom-cloud",
    137693: "telecom-cloud",
    58519: "hosting",
    199785: "hosting",
    204916: "hosting",
    36352: "hosting",
    18779: "hosting",
    23576: "hosting",
    48282: "hosting",
    51396: "hosting",
    55286: "hosting",
    142002: "hosting",
    198584: "hosting",
    216071: "hosting",
    394474: "hosting",
    9009: "hosting",
    46261: "hosting",
    212512: "hosting",
    11878: "hosting",
    49505: "hosting",
    50340: "hosting",
    26548: "hosting",
    64267: "hosting",
}
NEW_HOSTING_ASNS = (9009, 46261, 212512, 11878, 49505, 50340, 26548, 64267)
EXPANDED_PROVIDERS = ("tencent", "alibaba", "huawei", "baidu", "telecom-cloud", "hosting")

# Whole words in an organisation name that mark a hosting network.
HOSTING_WORDS = (
    "cloud",
    "hosting",
    "server",
    "datacenter",
    "data center",
    "vps",
    "virtual private server",
    "compute",
    "infrastructure",
    "colocation",
    "colo",
    "idc",
    "cdn",
)

# --- Fixed values: organisation keywords of the network review ------------------------------------
ORG_MAJOR_CLOUD = ("tencent", "alibaba", "baidu", "huawei")
ORG_CDN = ("cloudflare", "akamai", "fastly", "cdn")
ORG_TELECOM = ("china", "telecom", "unicom", "mobile")
ORG_TELECOM_CLOUD = ("cloud", "idc")
ORG_HOSTING = (
    "cloud",
    "hosting",
    "server",
    "datacenter",
    "data center",
    "vps",
    "virtual",
    "compute",
    "infrastructure",
    "colocation",
    "colo",
    "network services",
    "internet services",
)
ORG_PROXY_SELLERS = ("quickpacket", "m247", "selectel", "detai", "purevoltage", "tzulo", "sprio")
ORG_SUSPECT = ORG_PROXY_SELLERS + ("hosting", "datacenter", "server", "cloud", "vps")
ORG_CHEAP_HOSTS = (
    "CHEAPY-HOST",
    "Datacamp Limited",
    "Servers Tech",
    "Clouvider",
    "UK-2 Limited",
    "GSL Networks",
)
ORG_WARP = "Cloudflare, Inc."
WARP_PREFIX = "2a06:98c0:"
ORG_CORPORATE_LIKE = "Kaspersky"
ORG_CORPORATE_EXACT = ("PJSC MegaFon", "Rostelecom")

# --- Fixed values: report topics for free-text routing, as (id, name, keywords) -------------------
REPORT_TOPICS = (
    (
        "unique-ips",
        "Unique IP Addresses",
        ("unique ip", "unique ips", "all ips", "ip list", "ip addresses", "show ips"),
    ),
    ("subnet-clusters", "IP Subnet Clusters", ("subnet", "network", "ip cluster", "same ip range", "ip block")),
    (
        "time-bursts",
        "Traffic Burst Activity",
        ("burst", "rapid", "spike", "sequential", "time cluster", "fast requests"),
    ),
    ("datacenter-ips", "Datacenter Traffic", ("datacenter", "cloud", "aws", "azure", "gcp", "hosting")),
    ("residential-patterns", "Residential Traffic", ("residential", "home", "isp", "consumer", "non-datacenter")),
    ("asn-analysis", "ASN Analysis", ("asn", "autonomous system", "network provider", "isp")),
    ("geographic-clusters", "Geographic Clusters", ("geographic", "location", "country", "city", "region")),
)


def whole_words(words: Iterable[str]) -> str:
    """Case-insensitive test for any of the words bounded by ASCII word edges."""
    return "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(words) + ")(?![A-Za-z0-9_])"

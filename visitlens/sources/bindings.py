"""Web events derived from the supplied ``events`` table by integer arithmetic.

``u`` is the user, ``e`` the event and ``k`` the number in ``props``. The value lists below are test
inputs; the check SQL renders the same lists, and restates every derivation on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.settings import DEFAULT

AS_OF = "2024-01-31 00:00:00"
#: Parts that ``spread_events`` makes for each core.
PARTS_A_CORE = 4

AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Linux; Android 10; K) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/141.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17 Safari/605.1.15",
    None,
    "",
    "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; GPTBot/1.2)",
    "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; ClaudeBot/1.0)",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.example.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) HeadlessChrome/120.0.0.0 Safari/537.36",
    "curl/7.68.0",
    "Mozilla/5.0 (compatible; UptimeRobot/2.0)",
    "StatusCake",
    "Monitoring agent 1.0",
    "Cloudflare Custom Hostname 1.0",
    "Applebot/0.1",
    "Applebot-Extended/0.1",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/119.0 Safari/537.36 webdriver",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Edge/18.19041",
    "okhttp/4.9.1",
    "Perplexity-User/1.0",
    "Reader with a rather long name that has more than fifty characters in it",
)

PATHS = (
    "/",
    "/robots.txt",
    "/index.html",
    "/topics/dementia-care.html",
    "/posts/thailand-dementia-memory-care.html",
    "/posts/Memory-tips.html",
    "/data/x-dementia.json",
    "/about.html",
    "/articles/a.html",
    "/articles/b.html",
    "/wp-admin/setup.php",
    "/wp-login.php",
    "/blog/wp-content/plugins/x.js",
    "/license.txt",
    "/files/alfa.php",
    "/files/C99.PHP",
    "/tools/function.php",
    "/plain/page.php",
    "/.env",
    "/config.json",
    "/x/phpMyAdmin/",
    "/.git/HEAD",
    "/a/../../etc/passwd",
    "/q/union-all-select",
    "/run/eval(1)",
    "/.well-known/cf-custom-hostname-challenge/1",
    "/favicon.ico",
    "/news/today.html",
    "/backup.old",
    "/guide/page~",
    "/contact.html",
    "/sitemap.xml",
    "/admin/users",
)

# (asn, owner, provider stored with the event)
NETWORKS = (
    (8075, "MICROSOFT-CORP-MSN-AS-BLOCK", "azure"),
    (15169, "GOOGLE", "gcp"),
    (132203, "Tencent Building, Kejizhongyi Avenue", None),
    (9009, "M247 Europe SRL", None),
    (45090, "Shenzhen Tencent Computer Systems", "tencent"),
    (64500, "Example Cloud Hosting Ltd", None),
    (64501, "AS64501 Budget VPS Server Farm", None),
    (64502, "Home Broadband Networks", None),
    (64503, "China Mobile Cloud IDC", None),
    (13335, "Cloudflare, Inc.", None),
    (64504, "Datacamp Limited", None),
    (64505, "Kaspersky Lab", None),
    (64506, "Rostelecom", None),
    (None, None, None),
    (64507, "Écloud Réseaux", None),
    (64508, "Akamai Technologies", None),
    (49505, "JSC Selectel", "hosting"),
)
WARP_NETWORK = 9

LABELS = (
    "human",
    "human",
    "bot_undetermined",
    "ai_official",
    "ai_stealth",
    "web_crawler",
    "human",
    "human",
    "bot_undetermined",
    "monitoring_service",
    "attack",
    "bot_undetermined",
)
ATTACKS = (
    "attack_wordpress_scanner",
    "attack_webshell_scanner",
    "attack_config_scanner",
    "attack_exploit_attempt",
)
OFFICIAL_NAMES = ("GPTBot", "ClaudeBot", "PerplexityBot")


def pick(values, index: Column, kind: str = "string") -> Column:
    """Element of a literal list by a zero-based index column."""
    items = ", ".join("null" if v is None else repr(v) for v in values)
    return F.get(F.expr(f"cast(array({items}) as array<{kind}>)"), index.cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(values, index: str) -> str:
    items = ", ".join("null" if v is None else repr(v) for v in values)
    return f"get(array({items}), int({index}))"


def _moment(start: str, tenths: str) -> str:
    return f"timestamp_micros(unix_micros(timestamp'{start}') + ({tenths}) * 100000)"


XIP_FIRST, XIP_SECOND = DEFAULT.excluded_ips
FIRST, SECOND, THIRD = DEFAULT.funnel_sites
SITES = (
    THIRD,
    FIRST,
    f"www.{THIRD}",
    SECOND,
    THIRD,
    f"www.{FIRST}",
    "other.example.net",
    THIRD,
    FIRST,
    SECOND,
    THIRD,
    f"www.{SECOND}",
    FIRST,
    DEFAULT.excluded_sites[0],
)
NETWORK = f"if(u % 20 = 19, {WARP_NETWORK}, u % 17)"

# Some users get dense activity, so that the rate rules have something to find.
COLUMNS = {
    "id": "e",
    "timestamp": f"""case when u % 20 = 19 then {_moment('2024-01-30 10:00:00', '(e % 40) * 600')}
        when u % 12 = 0 then {_moment('2024-01-30 08:00:00', 'e % 1000')}
        when u % 12 = 6 then {_moment('2024-01-10 08:00:00', 'e % 1000')}
        when u % 6 = 1 then {_moment('2024-01-25 00:00:00', '(e % 5000) * 1000')}
        when u % 6 = 2 then {_moment('2024-01-30 20:00:00', '(e % 40) * 100')}
        else timestamp(ts) end""",
    "duration": "value / 1000.0D",
    "client_ip": f"""case when u = 0 then '{XIP_FIRST}' when u = 1 then '{XIP_SECOND}'
        when u % 20 = 19 then concat('2a06:98c0:3600::', u % 9973, ':', e % 5)
        when u % 10 = 9 then concat('2001:db8:', u % 7, ':', u % 5, '::', u % 9973)
        else concat('10.', u % 4, '.', u % 8, '.', u % 250) end""",
    "subnet": f"""case when u = 0 then '{XIP_FIRST.rsplit(".", 1)[0]}.0/24'
        when u = 1 then '{XIP_SECOND.rsplit(".", 1)[0]}.0/24'
        when u % 20 = 19 then concat('2a06:98c0:3600:', u % 9973, '::/64')
        when u % 10 = 9 then concat('2001:db8:', u % 7, ':', u % 5, '::/64')
        else concat('10.', u % 4, '.', u % 8, '.0/24') end""",
    "country": "if(u % 11 <> 3, concat(chr(65 + u % 25), chr(65 + u % 5)), null)",
    "city": "if(u % 19 <> 7, concat('NATION_', u % 25), null)",
    "latitude": "if(u % 14 <> 13, ((u % 25) * 15000 - 200000 + (k % 4) * 11) / 10000.0D, null)",
    "longitude": "if(u % 14 <> 13, ((u % 25) * 32500 - 1000000 + (k % 3) * 17) / 10000.0D, null)",
    "cf_ray": "concat('ray-', e)",
    "asn": _element([n[0] for n in NETWORKS], NETWORK),
    "asn_org": _element([n[1] for n in NETWORKS], NETWORK),
    "datacenter_provider": _element([n[2] for n in NETWORKS], NETWORK),
    "site": _element(SITES, "e % 14"),
    "method": "if(event_type = 'purchase', 'POST', 'GET')",
    "path": f"if(u % 6 = 1, concat('/posts/page-', e % 500, '.html'), {_element(PATHS, f'k % {len(PATHS)}')})",
    "query_string": "if(k % 5 = 0, concat('page=', k), null)",
    "status": "if(event_type = 'error', 404, 200)",
    "response_size": "bigint(floor(value * 100 + 0.5D))",
    "user_agent": _element(AGENTS, f"u % {len(AGENTS)}"),
    "has_sec_fetch_headers": "if(u % 13 <> 5, u % 3 = 0, null)",
    "has_client_hints": "if(u % 13 <> 5, u % 6 = 0, null)",
    "is_mobile": "k % 4 = 0",
    "base": _element(LABELS, "u % 12"),
    "k": "k",
}
LABEL_COLUMN = f"""case when k = 97 then null when k = 98 then 'official_ai' when k = 99 then 'stealth_ai'
    when base = 'attack' then {_element(ATTACKS, 'k % 4')} else base end"""
LABEL_DETAILS = {
    "is_bot": "coalesce(bot_classification <> 'human', false)",
    "bot_name": f"""case
        when bot_classification in ('ai_official', 'official_ai') then {_element(OFFICIAL_NAMES, 'id % 3')}
        when bot_classification in ('ai_stealth', 'stealth_ai') then 'AZURE-Stealth-AI'
        when bot_classification = 'web_crawler' then 'Googlebot'
        when bot_classification = 'monitoring_service' then 'UptimeRobot'
        when bot_classification = 'bot_undetermined' then 'Undetermined-Bot'
        when bot_classification like 'attack_%' then 'Scanner' end""",
    "detection_level": """case
        when bot_classification in ('ai_official', 'official_ai', 'web_crawler') then 1
        when bot_classification like 'attack_%' then 1
        when bot_classification in ('ai_stealth', 'stealth_ai', 'monitoring_service') then 2
        when bot_classification = 'bot_undetermined' then 3 end""",
}


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_from(table(spark, sf_dir, "events"))


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events dealt to all cores, several parts each.

    Rows of the table are narrow and its file has few parts; the lines and labels made of them take far longer.
    """
    parts = PARTS_A_CORE * spark.sparkContext.defaultParallelism
    return web_from(table(spark, sf_dir, "events").repartition(parts))


def web_from(raw: DataFrame) -> DataFrame:
    """Stored events with labels of both vocabularies and a few missing ones, batch or streaming."""
    keys = raw.selectExpr(
        "user_id as u", "event_id as e", "int(regexp_extract(props, '([0-9]+)', 1)) as k", "ts", "event_type", "value"
    )
    columns = keys.selectExpr(*[f"{text} as {name}" for name, text in COLUMNS.items()])
    stored = [name for name in COLUMNS if name not in ("base", "k")]
    labelled = columns.selectExpr(*stored, f"{LABEL_COLUMN} as bot_classification")
    return labelled.selectExpr("*", *[f"{text} as {name}" for name, text in LABEL_DETAILS.items()])


def request_headers(web: DataFrame) -> DataFrame:
    """Web events with the header bag their flags and keys stand for."""
    e = F.col("id")

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), F.array(value).alias("value")))

    sec_fetch = F.col("has_sec_fetch_headers")
    hints = F.col("has_client_hints")
    entries = F.array_compact(
        F.array(
            header("Cf-Connecting-Ip", F.when(e % 3 == 0, F.col("client_ip"))),
            header("X-Forwarded-For", F.when(e % 3 == 1, F.col("client_ip"))),
            header("Cf-Ray", F.col("cf_ray")),
            header("User-Agent", F.col("user_agent")),
            header("Sec-Fetch-Site", F.when(sec_fetch & (e % 4 != 0), F.lit("none"))),
            header("Sec-Fetch-Mode", F.when(sec_fetch, F.lit("navigate"))),
            header("Sec-Fetch-User", F.when(e % 11 == 0, F.lit("?1"))),
            header("Sec-Ch-Ua", F.when(hints, F.lit('"Chrome";v="120"'))),
            header("Sec-Ch-Ua-Mobile", F.when(hints & F.col("is_mobile"), F.lit("?1"))),
            header("Accept", F.when(e % 2 == 0, F.lit("text/html,application/xhtml+xml"))),
            header("Webdriver", F.when(e % 29 == 0, F.lit("1"))),
            header("From", F.when(e % 17 == 0, F.lit("bot@example.org"))),
            header("X-Openai-Host-Hash", F.when(e % 19 == 0, _text("h", e % 7))),
            header("Cf-Worker", F.when(e % 23 == 0, F.lit("worker.example.net"))),
            header("Cf-Ipcountry", F.when(e % 2 == 0, F.lit("DE"))),
            header("Referer", F.when(e % 5 == 0, F.lit("https://example.org/"))),
        )
    )
    return web.select("*", F.explode(F.array(F.map_from_entries(entries))).alias("headers"))


def raw_lines(web: DataFrame) -> DataFrame:
    """Web events written back as the log lines they could have come from, some of them unusable."""
    bag = request_headers(web)
    e = F.col("id")
    request = F.struct(
        F.when(e % 3 == 2, F.col("client_ip")).alias("client_ip"),
        F.when(e % 41 != 5, F.col("client_ip")).alias("remote_ip"),
        F.when(e % 53 != 0, F.col("site")).alias("host"),
        F.when(e % 59 != 0, F.col("method")).alias("method"),
        F.concat(
            F.col("path"),
            F.when(F.col("query_string").isNotNull(), F.concat(F.lit("?"), F.col("query_string"), F.lit("?rest"))).otherwise(""),
        ).alias("uri"),
        F.col("headers"),
    )
    record = F.struct(
        F.when(e % 47 == 0, "http.handlers").otherwise("http.log.access.log0").alias("logger"),
        (F.unix_micros("timestamp") / 1e6).alias("ts"),
        F.when(e % 61 != 0, F.col("duration")).alias("duration"),
        F.col("status"),
        F.when(e % 67 != 0, F.col("response_size")).alias("size"),
        request.alias("request"),
    )
    line = F.when(e % 97 == 0, _text('{"logger":"http.log.access.log0", cut off ', e)).otherwise(F.to_json(record))
    # Behind a generator the rendered line is computed once, as it would be read from a file.
    return bag.select(F.explode(F.array(line)).alias("value"))


def ban_decisions(web: DataFrame) -> DataFrame:
    """Decisions about addresses that end in 7, with repeats and empty values."""
    value = F.when(F.col("id") % 2 == 0, F.col("client_ip")).otherwise("")
    return web.where("client_ip like '%7'").select(value.alias("value"))


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested CIDR blocks with places, derived from the users' addresses."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    u = F.col("u")
    v4 = (u > 1) & (u % 10 != 9)
    a, b, c = u % 4, u % 8, u % 250

    def block(condition, network, country, city, lat, lon) -> Column:
        return F.when(
            condition,
            F.struct(
                network.alias("network"),
                country.alias("country"),
                city.alias("city"),
                lat.cast("double").alias("latitude"),
                lon.cast("double").alias("longitude"),
            ),
        )

    nothing = F.lit(None).cast("string")
    blocks = F.array_compact(
        F.array(
            block(v4, F.lit("10.0.0.0/8"), F.lit("ZZ"), nothing, F.lit(1.5), F.lit(0.0)),
            block(v4 & (b % 2 == 0), _text("10.", a, ".", b, ".0/24"), _text("A", a), _text("City-", a, "-", b), a * 10 + b, b - 90),
            block(v4 & (c % 10 == 0), _text("10.", a, ".", b, ".", c, "/32"), F.lit("HH"), _text("Host-", c), c, -c),
            block(u % 20 == 9, F.lit("2001:0DB8::/32"), F.lit("VV"), nothing, F.lit(6.25), F.lit(7.75)),
            block(
                (u % 20 == 9) & ((u % 7 + u % 5) % 2 == 0),
                _text("2001:db8:", u % 7, ":", u % 5, "::/64"),
                F.lit("VW"),
                _text("Six-", u % 7, "-", u % 5),
                u % 7,
                u % 5,
            ),
        )
    )
    return users.select(F.inline(blocks)).distinct()


def asn_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIDR blocks with owners, derived from the users' addresses."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    u = F.col("u")
    v4 = (u > 1) & (u % 10 != 9)
    network = u % 8 + 1

    def block(condition, cidr, index) -> Column:
        owner = F.struct(
            cidr.alias("network"),
            pick([n[0] for n in NETWORKS], index, "int").alias("asn"),
            pick([n[1] for n in NETWORKS], index).alias("asn_org"),
        )
        return F.when(condition, owner)

    blocks = F.array_compact(
        F.array(
            block(v4, _text("10.", u % 4, ".", u % 8, ".0/24"), network),
            block(u % 20 == 19, F.lit("2a06:98c0::/29"), F.lit(WARP_NETWORK)),
        )
    )
    return users.select(F.inline(blocks)).distinct()

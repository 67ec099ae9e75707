"""Check SQL for DuckDB: every registered query stated a second time, on its own.

Value lists and rule tables are rendered from the same data the library uses; the logic around them
is written out here. Shares and rounded percentages use integer arithmetic, so that rounding is
exact; LIKE and regular expressions use DuckDB's own.
"""

from __future__ import annotations

from visitlens.functions import rules as R
from visitlens.plans.journeys import HARVEST_DIVERSITY, HARVEST_PATHS
from visitlens.settings import DEFAULT
from visitlens.sources import bindings as B

AS_OF = f"TIMESTAMP '{B.AS_OF}'"
XIP = "('184.82.29.117', '123.25.101.101')"
HOME = "'184.82.29.117'"


def lit(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def inside(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def pick(values, index: str) -> str:
    return f"({listing(values)})[CAST({index} AS INT) + 1]"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def pct(part: str, whole: str, digits: int) -> str:
    scale = 10**digits
    return f"(CAST(({part}) * {200 * scale} + ({whole}) AS BIGINT) // CAST(2 * ({whole}) AS BIGINT)) / {scale}.0::DOUBLE"


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def arr(x: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), ',')"


def span(a: str = 'min("timestamp")', b: str = 'max("timestamp")') -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6)"


def ilike_any(column: str, words) -> str:
    return "(" + " OR ".join(f"{column} ILIKE '%{w}%'" for w in words) + ")"


def re2(pattern: str) -> str:
    return pattern.replace(r"\z", "$").replace("'", "''")


def hit(column: str, patterns) -> str:
    """Case-insensitive search for any of a family's patterns."""
    folded = "|".join(f"(?:{re2(p)})" for p in patterns)
    return f"regexp_matches({column}, '{folded}', 'i')"


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
    "intranet.example.net",
)


def moment(start: str, micros: str) -> str:
    return f"TIMESTAMP '{start}' + to_microseconds(CAST({micros} AS BIGINT))"


NET = f"CASE WHEN u % 20 = 19 THEN {B.WARP_NETWORK} ELSE u % 17 END"
WEB = f"""
b AS (
  SELECT user_id AS u, event_id AS e, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, ts, event_type, value
  FROM events
),
w0 AS (
  SELECT u, e, k, e AS id,
    CASE WHEN u % 20 = 19 THEN {moment('2024-01-30 10:00:00', '(e % 40) * 60000000')}
         WHEN u % 12 = 0 THEN {moment('2024-01-30 08:00:00', '(e % 1000) * 100000')}
         WHEN u % 12 = 6 THEN {moment('2024-01-10 08:00:00', '(e % 1000) * 100000')}
         WHEN u % 6 = 1 THEN {moment('2024-01-25 00:00:00', '(e % 5000) * 100000000')}
         WHEN u % 6 = 2 THEN {moment('2024-01-30 20:00:00', '(e % 40) * 10000000')}
         ELSE ts END AS "timestamp",
    value / 1000.0 AS duration,
    CASE WHEN u = 0 THEN '184.82.29.117' WHEN u = 1 THEN '123.25.101.101'
         WHEN u % 20 = 19 THEN concat('2a06:98c0:3600::', u % 9973, ':', e % 5)
         WHEN u % 10 = 9 THEN concat('2001:db8:', u % 7, ':', u % 5, '::', u % 9973)
         ELSE concat('10.', u % 4, '.', u % 8, '.', u % 250) END AS client_ip,
    CASE WHEN u = 0 THEN '184.82.29.0/24' WHEN u = 1 THEN '123.25.101.0/24'
         WHEN u % 20 = 19 THEN concat('2a06:98c0:3600:', u % 9973, '::/64')
         WHEN u % 10 = 9 THEN concat('2001:db8:', u % 7, ':', u % 5, '::/64')
         ELSE concat('10.', u % 4, '.', u % 8, '.0/24') END AS subnet,
    CASE WHEN u % 11 <> 3 THEN chr(CAST(65 + u % 25 AS INT)) || chr(CAST(65 + u % 5 AS INT)) END AS country,
    CASE WHEN u % 19 <> 7 THEN concat('NATION_', u % 25) END AS city,
    CASE WHEN u % 14 <> 13 THEN ((u % 25) * 15000 - 200000 + (k % 4) * 11) / 10000.0::DOUBLE END AS latitude,
    CASE WHEN u % 14 <> 13 THEN ((u % 25) * 32500 - 1000000 + (k % 3) * 17) / 10000.0::DOUBLE END AS longitude,
    concat('ray-', e) AS cf_ray,
    CAST({pick([n[0] for n in B.NETWORKS], NET)} AS BIGINT) AS asn,
    {pick([n[1] for n in B.NETWORKS], NET)} AS asn_org,
    {pick([n[2] for n in B.NETWORKS], NET)} AS datacenter_provider,
    {pick(SITES, 'e % 14')} AS site,
    CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN u % 6 = 1 THEN concat('/posts/page-', e % 500, '.html')
         ELSE {pick(B.PATHS, f'k % {len(B.PATHS)}')} END AS path,
    CASE WHEN k % 5 = 0 THEN concat('page=', k) END AS query_string,
    CAST(CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS BIGINT) AS status,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS response_size,
    {pick(B.AGENTS, f'u % {len(B.AGENTS)}')} AS user_agent,
    CASE WHEN u % 13 <> 5 THEN u % 3 = 0 END AS has_sec_fetch_headers,
    CASE WHEN u % 13 <> 5 THEN u % 6 = 0 END AS has_client_hints,
    k % 4 = 0 AS is_mobile,
    {pick(B.LABELS, 'u % 12')} AS base
  FROM b
),
w1 AS (
  SELECT *, CASE WHEN k = 97 THEN NULL WHEN k = 98 THEN 'official_ai' WHEN k = 99 THEN 'stealth_ai'
                 WHEN base = 'attack' THEN {pick(B.ATTACKS, 'k % 4')} ELSE base END AS bot_classification
  FROM w0
),
web AS (
  SELECT *, coalesce(bot_classification <> 'human', false) AS is_bot,
    CASE WHEN bot_classification IN ('ai_official', 'official_ai') THEN {pick(B.OFFICIAL_NAMES, 'e % 3')}
         WHEN bot_classification IN ('ai_stealth', 'stealth_ai') THEN 'AZURE-Stealth-AI'
         WHEN bot_classification = 'web_crawler' THEN 'Googlebot'
         WHEN bot_classification = 'monitoring_service' THEN 'UptimeRobot'
         WHEN bot_classification = 'bot_undetermined' THEN 'Undetermined-Bot'
         WHEN bot_classification LIKE 'attack_%' THEN 'Scanner' END AS bot_name,
    CAST(CASE WHEN bot_classification IN ('ai_official', 'official_ai', 'web_crawler')
              OR bot_classification LIKE 'attack_%' THEN 1
         WHEN bot_classification IN ('ai_stealth', 'stealth_ai', 'monitoring_service') THEN 2
         WHEN bot_classification = 'bot_undetermined' THEN 3 END AS BIGINT) AS detection_level
  FROM w1
)"""

ORACLES: dict[str, str] = {}


def web(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = "WITH " + ",\n".join([WEB, *ctes]) + "\n" + select


HOURS = {"6h": 6, "24h": 24, "7d": 168, "30d": 720}
TOPIC = f"""(site <> '{THIRD}' OR path ILIKE '%dementia%' OR path ILIKE '%memory%'
  OR path LIKE '/topics/dementia-care.html' OR path LIKE '/posts/thailand-dementia-memory-care.html'
  OR path LIKE '/data%dementia%' OR path LIKE '/data-output%dementia%')"""


def recent(rng: str) -> str:
    return f'"timestamp" > {AS_OF} - INTERVAL {HOURS[rng]} HOUR AND "timestamp" <= {AS_OF}'


def scope(rng: str, topic: bool = False) -> str:
    return f"{recent(rng)} AND client_ip NOT IN {XIP}" + (f" AND {TOPIC}" if topic else "")


def n_class(label: str, name: str) -> str:
    return f"count(*) FILTER (WHERE bot_classification = '{label}') AS {name}"


ATTACK = "bot_classification LIKE 'attack_%'"
STATS = f"""SELECT count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips,
  {n_class('ai_official', 'ai_official')}, {n_class('ai_stealth', 'ai_stealth')},
  {n_class('web_crawler', 'web_crawler')}, {n_class('monitoring_service', 'monitoring_service')},
  {n_class('bot_undetermined', 'bot_undetermined')}, count(*) FILTER (WHERE {ATTACK}) AS attack_traffic,
  {n_class('human', 'human')} FROM web WHERE """

# --- Dashboard
web("overall_stats", STATS + scope("30d", True))
web("overall_stats_day", STATS + scope("24h"))
HOSTS = inside([FIRST, SECOND, THIRD, f"www.{FIRST}", f"www.{SECOND}", f"www.{THIRD}"])
SECONDS = {"6h": 300, "24h": 3600, "7d": 7200, "30d": 86400}


def timeline(rng: str, topic: bool) -> str:
    width = SECONDS[rng]
    return f"""tl AS (SELECT make_timestamp((epoch_us("timestamp") // {width}000000) * {width}000000) AS tb,
      replace(site, 'www.', '') AS site, count(DISTINCT client_ip) AS n
    FROM web WHERE {scope(rng, topic)} AND site IN {HOSTS} GROUP BY 1, 2)"""


for _rng in HOURS:
    web(f"timeline_{_rng}", f"SELECT {ts('tb')} AS time_bucket, site, n AS count FROM tl", timeline(_rng, False))
    web(
        f"filled_timeline_{_rng}",
        f"SELECT {ts('g.tb')} AS time_bucket, g.site, coalesce(tl.n, 0) AS count FROM grid g LEFT JOIN tl USING (tb, site)",
        timeline(_rng, True),
        f"""grid AS (SELECT unnest(generate_series((SELECT min(tb) FROM tl), (SELECT max(tb) FROM tl),
              INTERVAL {SECONDS[_rng]} SECOND)) AS tb, s.site
            FROM (VALUES ('{FIRST}'), ('{SECOND}'), ('{THIRD}')) s(site))""",
    )
DISPLAY = f"""CASE bot_classification WHEN 'human' THEN 'Human' WHEN 'ai_official' THEN 'Official AI'
  WHEN 'ai_stealth' THEN 'Stealth AI' WHEN 'web_crawler' THEN 'Web Crawler'
  WHEN 'monitoring_service' THEN 'Monitoring' WHEN 'bot_undetermined' THEN 'Undetermined Bot'
  ELSE CASE WHEN {ATTACK} THEN 'Attack Traffic' ELSE 'Unknown' END END"""
web("classification_breakdown", f"SELECT {DISPLAY} AS name, count(*) AS count FROM web WHERE {scope('7d')} GROUP BY 1")


def bots(rng: str, topic: bool) -> str:
    return f"""SELECT bot_name AS name, count(*) AS count FROM web WHERE {scope(rng, topic)}
      AND is_bot AND bot_name IS NOT NULL GROUP BY 1 ORDER BY count DESC, name LIMIT 10"""


web("top_bots", bots("30d", True))
ORACLES["busiest_bots"] = ORACLES["top_bots"]


def heat(rng: str) -> str:
    return f"""heat AS (SELECT {rnd('latitude', 2)} AS lat, {rnd('longitude', 2)} AS lng, count(*) AS count, country, city,
      {n_class('human', 'human_count')}, {n_class('ai_official', 'official_ai_count')},
      {n_class('ai_stealth', 'stealth_ai_count')}, {n_class('web_crawler', 'web_crawler_count')},
      {n_class('monitoring_service', 'monitoring_count')}, count(*) FILTER (WHERE {ATTACK}) AS attack_count
    FROM web WHERE {scope(rng)} AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, country, city)"""


web("geo_heatmap", "SELECT * FROM heat", heat("30d"))
web(
    "coloured_heatmap",
    """SELECT *, CASE WHEN m = 0 THEN 'Default' WHEN human_count = m THEN 'Human' WHEN official_ai_count = m
      THEN 'Official AI' WHEN stealth_ai_count = m THEN 'Stealth AI' WHEN web_crawler_count = m THEN 'Web Crawler'
      ELSE 'Monitoring' END AS dominant_class FROM (SELECT *, greatest(human_count, official_ai_count,
      stealth_ai_count, web_crawler_count, monitoring_count) AS m FROM heat)""".replace(
        "SELECT *, CASE", "SELECT * EXCLUDE (m), CASE"
    ),
    heat("7d"),
)
web(
    "traffic_shares",
    "SELECT total_requests, unique_ips, "
    + ", ".join(
        f"{pct(c, 'total_requests', 1)} AS {n}_pct"
        for n, c in (
            ("human", "human"),
            ("ai_official", "ai_official"),
            ("ai_stealth", "ai_stealth"),
            ("web_crawler", "web_crawler"),
            ("monitoring", "monitoring_service"),
            ("undetermined", "bot_undetermined"),
            ("attack", "attack_traffic"),
        )
    )
    + " FROM st",
    f"st AS ({STATS}{scope('30d')})",
)
web(
    "dashboard_bundle",
    f"""SELECT 'stats' AS frame, 'total' AS key, count(*) AS count FROM web WHERE {scope('7d')}
    UNION ALL SELECT 'timeline', site, CAST(sum(n) AS BIGINT) FROM tl GROUP BY site
    UNION ALL SELECT 'classes', {DISPLAY}, count(*) FROM web WHERE {scope('7d')} GROUP BY 2
    UNION ALL SELECT 'bots', name, count FROM ({bots('7d', False)})""",
    timeline("7d", False),
)

# --- Explorer
web(
    "subnet_clusters",
    f"""SELECT subnet, bot_classification, datacenter_provider, asn, asn_org, count(*) AS total_requests,
      count(DISTINCT client_ip) AS unique_ips, {arr('country')} AS countries
    FROM web WHERE {scope('30d')} AND subnet IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
    ORDER BY total_requests DESC, subnet NULLS FIRST, bot_classification NULLS FIRST, datacenter_provider NULLS FIRST,
      asn NULLS FIRST, asn_org NULLS FIRST LIMIT 200""",
)
web(
    "time_bursts",
    f"""SELECT {ts('hr')} AS time_bucket, client_ip, subnet, bot_classification, datacenter_provider, burst_size, paths_visited
    FROM (SELECT date_trunc('hour', "timestamp") AS hr, client_ip, subnet, bot_classification, datacenter_provider,
      count(*) AS burst_size, {arr('path')} AS paths_visited
    FROM web WHERE {scope('6h')} GROUP BY ALL HAVING count(*) >= 20
    ORDER BY burst_size DESC, hr, client_ip, subnet, bot_classification NULLS FIRST, datacenter_provider NULLS FIRST LIMIT 200)""",
)
web(
    "datacenter_ips",
    f"""SELECT client_ip, datacenter_provider, asn, asn_org, bot_classification, user_agent, count(*) AS request_count,
      {arr('country')} AS countries
    FROM web WHERE {scope('7d')} AND datacenter_provider IS NOT NULL GROUP BY ALL
    ORDER BY request_count DESC, client_ip, datacenter_provider, asn NULLS FIRST, asn_org NULLS FIRST,
      bot_classification NULLS FIRST, user_agent NULLS FIRST LIMIT 200""",
)
web(
    "residential_patterns",
    f"""SELECT subnet, country, bot_classification, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips,
      CASE WHEN bot_classification = 'human' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS human_percentage
    FROM web WHERE {scope('30d')} AND datacenter_provider IS NULL AND subnet IS NOT NULL GROUP BY subnet, country,
      bot_classification HAVING count(*) >= 10
    ORDER BY request_count DESC, subnet, country NULLS FIRST, bot_classification NULLS FIRST LIMIT 200""",
)


def asn_report(official: str, hidden: str) -> str:
    return f"""SELECT asn, asn_org, datacenter_provider, count(*) AS total_requests,
      count(DISTINCT client_ip) AS unique_ips, {n_class('human', 'human_count')}, {n_class(official, 'official_ai_count')},
      {n_class(hidden, 'stealth_ai_count')}, {n_class('web_crawler', 'web_crawler_count')}, {arr('country')} AS countries
    FROM web WHERE {scope('30d')} AND asn IS NOT NULL GROUP BY asn, asn_org, datacenter_provider
    ORDER BY total_requests DESC, asn, asn_org NULLS FIRST, datacenter_provider NULLS FIRST LIMIT 100"""


web("asn_analysis", asn_report("official_ai", "stealth_ai"))
web("asn_analysis_current_labels", asn_report("ai_official", "ai_stealth"))
web(
    "unique_ips",
    f"""SELECT client_ip, subnet, bot_classification, country, city, datacenter_provider, asn_org,
      count(*) AS total_requests, {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen
    FROM web WHERE {scope('30d')} GROUP BY 1, 2, 3, 4, 5, 6, 7
    ORDER BY total_requests DESC, client_ip, subnet, bot_classification NULLS FIRST, country NULLS FIRST,
      city NULLS FIRST, datacenter_provider NULLS FIRST, asn_org NULLS FIRST LIMIT 500""",
)
ORACLES["busiest_ips"] = ORACLES["unique_ips"]
web(
    "geographic_clusters",
    f"""SELECT country, city, {rnd('avg(latitude)', 2)} AS avg_lat, {rnd('avg(longitude)', 2)} AS avg_lng,
      count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips,
      count(*) FILTER (WHERE datacenter_provider IS NOT NULL) AS datacenter_count, {n_class('human', 'human_count')},
      {n_class('stealth_ai', 'stealth_ai_count')}
    FROM web WHERE {scope('30d')} AND latitude IS NOT NULL AND longitude IS NOT NULL
    GROUP BY country, city HAVING count(*) >= 10
    ORDER BY total_requests DESC, country NULLS FIRST, city NULLS FIRST LIMIT 150""",
)

# --- Summaries
web(
    "bot_summary",
    f"""SELECT bot_classification, count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips,
      {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
      {rnd('avg(duration)', 4)} AS avg_duration_sec, {rnd('sum(response_size) / 1024.0 / 1024.0', 2)} AS total_mb
    FROM web WHERE is_bot GROUP BY 1""",
)
web(
    "daily_stats",
    """SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, site, bot_classification, count(*) AS requests,
      count(DISTINCT client_ip) AS unique_ips FROM web GROUP BY 1, 2, 3""",
)
web("class_counts", "SELECT bot_classification, count(*) AS count FROM web GROUP BY 1")


def shares(digits: int, where: str = "true") -> str:
    return f"""SELECT bot_classification, n AS count, {pct('n', 't', digits)} AS percentage
    FROM (SELECT bot_classification, count(*) AS n, (SELECT count(*) FROM web WHERE {where}) AS t
          FROM web WHERE {where} GROUP BY 1)"""


web("class_distribution", shares(2))
web("class_distribution_one_digit", shares(1))
web("label_shares", shares(1, f"client_ip NOT IN {XIP}"))
web(
    "metric_rows",
    """SELECT 'Total Events' AS metric, CAST(count(*) AS VARCHAR) AS value FROM web
    UNION ALL SELECT 'Human Events', CAST(count(*) AS VARCHAR) FROM web WHERE bot_classification = 'human'
    UNION ALL SELECT 'Bot Events', CAST(count(*) AS VARCHAR) FROM web WHERE is_bot
    UNION ALL SELECT 'Events Missing Sec-Fetch', CAST(count(*) AS VARCHAR) FROM web WHERE has_sec_fetch_headers = false""",
)
web(
    "attack_breakdown",
    f"SELECT bot_classification, count(*) AS count, count(DISTINCT client_ip) AS unique_ips FROM web WHERE {ATTACK} GROUP BY 1",
)
web(
    "human_checks",
    """SELECT count(*) FILTER (WHERE bot_classification = 'human' AND has_sec_fetch_headers) AS humans_with_sec_fetch,
      count(*) FILTER (WHERE bot_classification = 'human' AND has_sec_fetch_headers = false) AS humans_without_sec_fetch,
      count(*) FILTER (WHERE bot_classification = 'human' AND datacenter_provider IS NOT NULL) AS humans_from_datacenter
    FROM web""",
)
web(
    "new_providers",
    f"""SELECT datacenter_provider, count(*) AS count, count(DISTINCT client_ip) AS unique_ips, {arr('asn_org')} AS orgs
    FROM web WHERE datacenter_provider IN {inside(R.EXPANDED_PROVIDERS)} GROUP BY 1""",
)
GROUP = f"""CASE WHEN bot_classification = 'human' THEN 'Human Traffic'
  WHEN bot_classification IN ('ai_official', 'ai_stealth') THEN 'AI Bots'
  WHEN bot_classification = 'web_crawler' THEN 'Web Crawlers' WHEN {ATTACK} THEN 'Attack Traffic' ELSE 'Unknown' END"""
web("traffic_groups", f"SELECT {GROUP} AS traffic_group, count(*) AS count FROM web GROUP BY 1")
web(
    "rows_between",
    """SELECT count(*) AS count FROM web WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
      AND "timestamp" < TIMESTAMP '2024-01-20 23:59:59.999'""",
)

# --- Undetermined traffic
UND = "bot_classification = 'bot_undetermined'"
UNDX = f"{UND} AND client_ip <> {HOME}"
NO_AGENT = "coalesce(user_agent, '') = ''"
_OV = ("from_datacenters", "from_residential", "with_sec_fetch", "with_client_hints", "no_user_agent")
web(
    "undetermined_overview",
    "SELECT *, " + ", ".join(f"{pct(c, 'total_requests', 1)} AS {c}_pct" for c in _OV) + " FROM o",
    f"""o AS (SELECT count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips,
      count(DISTINCT path) AS unique_paths, count(DISTINCT user_agent) AS unique_user_agents,
      {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
      count(datacenter_provider) AS from_datacenters, count(*) - count(datacenter_provider) AS from_residential,
      count(*) FILTER (WHERE has_sec_fetch_headers) AS with_sec_fetch,
      count(*) FILTER (WHERE has_client_hints) AS with_client_hints,
      count(*) FILTER (WHERE {NO_AGENT}) AS no_user_agent FROM web WHERE {UNDX})""",
)
web(
    "undetermined_signals",
    f"""SELECT count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips, count(DISTINCT path) AS unique_paths,
      count(DISTINCT site) AS sites_affected, {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
      count(*) FILTER (WHERE NOT has_sec_fetch_headers) AS missing_sec_fetch,
      count(*) FILTER (WHERE NOT has_client_hints) AS missing_client_hints,
      count(*) FILTER (WHERE {NO_AGENT}) AS no_user_agent, count(datacenter_provider) AS from_datacenter
    FROM web WHERE {UND}""",
)
web(
    "undetermined_agents",
    f"""SELECT user_agent, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips,
      count(DISTINCT path) AS unique_paths FROM web WHERE {UNDX} AND user_agent <> '' GROUP BY 1
    ORDER BY request_count DESC, user_agent LIMIT 15""",
)
web(
    "undetermined_by_provider",
    f"""SELECT datacenter_provider, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips,
      {pct('count(*) FILTER (WHERE has_sec_fetch_headers)', 'count(*)', 0)} AS pct_with_sec_fetch
    FROM web WHERE {UNDX} AND datacenter_provider IS NOT NULL GROUP BY 1""",
)
web(
    "undetermined_active_ips",
    f"""SELECT client_ip, datacenter_provider, country, asn_org, has_sec_fetch_headers, has_client_hints,
      count(*) AS request_count, count(DISTINCT path) AS unique_paths, {arr('user_agent')} AS user_agents,
      {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
      CASE WHEN {span()} > 0 THEN {rnd('count(*) / ' + span(), 3)} END AS req_per_sec
    FROM web WHERE {UNDX} GROUP BY 1, 2, 3, 4, 5, 6
    ORDER BY request_count DESC, client_ip, datacenter_provider NULLS FIRST, country NULLS FIRST, asn_org NULLS FIRST,
      has_sec_fetch_headers NULLS FIRST, has_client_hints NULLS FIRST LIMIT 20""",
)
web(
    "undetermined_paths",
    f"""SELECT path, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips FROM web WHERE {UNDX}
    GROUP BY 1 ORDER BY request_count DESC, path LIMIT 25""",
)
web(
    "undetermined_by_hour",
    f"""SELECT extract(hour FROM "timestamp") AS hour, count(*) AS request_count FROM web WHERE {UNDX} GROUP BY 1""",
)
web(
    "undetermined_by_country",
    f"""SELECT country, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips,
      {pct('count(datacenter_provider)', 'count(*)', 0)} AS pct_datacenter
    FROM web WHERE {UNDX} AND country IS NOT NULL GROUP BY 1 ORDER BY request_count DESC, country LIMIT 15""",
)
web(
    "undetermined_behaviour",
    f"""SELECT count(*) FILTER (WHERE p = 1) AS single_path_ips, count(*) FILTER (WHERE p >= 5) AS multi_path_ips,
      count(*) FILTER (WHERE n >= 10) AS repeat_ips
    FROM (SELECT client_ip, count(DISTINCT path) AS p, count(*) AS n FROM web WHERE {UNDX} GROUP BY 1)""",
)
web(
    "undetermined_signal_ips",
    f"""SELECT client_ip, has_sec_fetch_headers, has_client_hints, count(*) AS request_count,
      count(DISTINCT path) AS unique_paths, max(user_agent) AS sample_ua, max(datacenter_provider) AS datacenter,
      max(country) AS country, max(city) AS city FROM web WHERE {UND} GROUP BY 1, 2, 3
    ORDER BY request_count DESC, client_ip, has_sec_fetch_headers NULLS FIRST, has_client_hints NULLS FIRST LIMIT 20""",
)
web(
    "undetermined_site_paths",
    f"""SELECT path, count(*) AS hit_count, count(DISTINCT client_ip) AS unique_ips, max(site) AS site FROM web
    WHERE {UND} GROUP BY 1 ORDER BY hit_count DESC, path LIMIT 30""",
)
FAMILY = f"""CASE WHEN {NO_AGENT} THEN 'No User-Agent'
  WHEN user_agent ILIKE '%Chrome%' AND user_agent ILIKE '%Safari%' THEN 'Chrome-like'
  WHEN user_agent ILIKE '%Firefox%' THEN 'Firefox-like'
  WHEN user_agent ILIKE '%Safari%' AND user_agent NOT ILIKE '%Chrome%' THEN 'Safari-like'
  WHEN user_agent ILIKE '%Edge%' THEN 'Edge-like' WHEN user_agent ILIKE '%curl%' THEN 'curl'
  WHEN user_agent ILIKE '%wget%' THEN 'wget' WHEN user_agent ILIKE '%python%' THEN 'Python'
  WHEN user_agent ILIKE '%java%' THEN 'Java' WHEN user_agent ILIKE '%okhttp%' THEN 'OkHttp'
  WHEN user_agent ILIKE '%go-http%' THEN 'Go HTTP Client' ELSE 'Other' END"""
REASON = f"""CASE WHEN {NO_AGENT} THEN 'No User-Agent'
  WHEN has_sec_fetch_headers = false AND datacenter_provider IS NULL THEN 'Missing Sec-Fetch (residential)'
  WHEN has_sec_fetch_headers = false AND datacenter_provider IS NOT NULL THEN 'Missing Sec-Fetch (datacenter)'
  WHEN has_client_hints = false AND has_sec_fetch_headers = true THEN 'Has Sec-Fetch but no Client Hints'
  ELSE 'Other reasons' END"""
web(
    "undetermined_agent_families",
    f"SELECT {FAMILY} AS ua_pattern, count(*) AS count, count(DISTINCT client_ip) AS unique_ips FROM web WHERE {UND} GROUP BY 1",
)
web(
    "undetermined_provider_counts",
    f"""SELECT coalesce(datacenter_provider, 'Residential/Unknown') AS provider, count(*) AS request_count,
      count(DISTINCT client_ip) AS unique_ips FROM web WHERE {UND} GROUP BY datacenter_provider""",
)
web(
    "undetermined_country_counts",
    f"""SELECT coalesce(c, 'Unknown') AS country, request_count, unique_ips FROM (
      SELECT country AS c, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips FROM web WHERE {UND}
      GROUP BY 1 ORDER BY request_count DESC, c NULLS FIRST LIMIT 15)""",
)
web(
    "undetermined_reasons",
    f"""SELECT reason, n AS count, {pct('n', 't', 1)} AS percentage FROM (
      SELECT {REASON} AS reason, count(*) AS n, (SELECT count(*) FROM web WHERE {UND}) AS t FROM web WHERE {UND} GROUP BY 1)""",
)
web(
    "undetermined_weekdays",
    f"""SELECT dayname("timestamp") AS day, dayofweek("timestamp") AS day_number, count(*) AS count FROM web WHERE {UND}
    GROUP BY 1, 2""",
)
web(
    "undetermined_fast_ips",
    f"""SELECT client_ip, count(*) AS request_count, {span()} AS duration_seconds, count(DISTINCT path) AS unique_paths,
      max(datacenter_provider) AS datacenter, max(user_agent) AS sample_ua FROM web WHERE {UND} AND {recent('7d')}
    GROUP BY 1 HAVING {span()} > 0 AND count(*) / {span()} > 0.1 ORDER BY count(*) / {span()} DESC, client_ip LIMIT 10""",
)

# --- Investigations
ORGS = f"""orgs AS (SELECT asn, asn_org, datacenter_provider, count(*) AS request_count,
    count(DISTINCT client_ip) AS unique_ips, {arr('country')} AS countries
  FROM web WHERE datacenter_provider IS NULL AND asn_org IS NOT NULL GROUP BY 1, 2, 3)"""


def has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(asn_org), '{w}')" for w in words) + ")"


CATS = f"""cats AS (SELECT *, CASE WHEN {has(('tencent', 'alibaba', 'baidu', 'huawei'))} THEN 'major_cloud'
    WHEN {has(('cloudflare', 'akamai', 'fastly', 'cdn'))} THEN 'cdn_proxy'
    WHEN {has(('china', 'telecom', 'unicom', 'mobile'))} AND {has(('cloud', 'idc'))} THEN 'telecom_cloud'
    WHEN {has(R.ORG_HOSTING)} THEN 'hosting_vps'
    WHEN request_count > 50 AND unique_ips > 10 THEN 'suspicious' END AS category FROM orgs)"""
web("unlisted_orgs", "SELECT * FROM orgs", ORGS)
web(
    "org_category_listing",
    """SELECT category, rank, asn, asn_org, request_count, unique_ips, countries,
      CASE category WHEN 'major_cloud' THEN CASE WHEN contains(lower(asn_org), 'tencent') THEN 'tencent'
          WHEN contains(lower(asn_org), 'alibaba') THEN 'alibaba' WHEN contains(lower(asn_org), 'baidu') THEN 'baidu'
          WHEN contains(lower(asn_org), 'huawei') THEN 'huawei' ELSE 'unknown' END
        WHEN 'cdn_proxy' THEN CASE WHEN contains(lower(asn_org), 'cloudflare') THEN 'cloudflare'
          WHEN contains(lower(asn_org), 'akamai') THEN 'akamai' WHEN contains(lower(asn_org), 'fastly') THEN 'fastly'
          ELSE 'cdn' END
        WHEN 'telecom_cloud' THEN 'telecom-cloud' END AS suggested
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY request_count DESC, asn NULLS FIRST, asn_org) AS rank
          FROM cats WHERE category IS NOT NULL)
    WHERE rank <= 1 OR category NOT IN ('hosting_vps', 'suspicious')""",
    ORGS,
    CATS,
)
ORACLES["org_category_listing_cut"] = ORACLES["org_category_listing"]
ORACLES["org_category_listing_full"] = ORACLES["org_category_listing"].replace("WHERE rank <= 1 OR", "WHERE true OR")
ORACLES["org_category_listing"] = ORACLES["org_category_listing"].replace(
    "rank <= 1 OR", "rank <= CASE category WHEN 'hosting_vps' THEN 30 WHEN 'suspicious' THEN 20 ELSE rank END OR"
)
TRACKED = "category IN ('major_cloud', 'cdn_proxy', 'telecom_cloud', 'hosting_vps')"
web(
    "org_category_totals",
    f"""SELECT count(*) FILTER (WHERE {TRACKED}) AS total_hosting,
      CAST(coalesce(sum(request_count) FILTER (WHERE {TRACKED}), 0) AS BIGINT) AS total_requests, """
    + ", ".join(
        f"count(*) FILTER (WHERE category = '{c}') AS {c}"
        for c in ("major_cloud", "cdn_proxy", "telecom_cloud", "hosting_vps", "suspicious")
    )
    + " FROM cats",
    ORGS,
    CATS,
)
RES_HUMAN = "bot_classification = 'human' AND datacenter_provider IS NULL"
SUSPECT = f"{RES_HUMAN} AND asn_org IS NOT NULL AND {ilike_any('asn_org', R.ORG_SUSPECT)}"
web(
    "hosting_humans",
    f"""SELECT asn_org, count(*) AS request_count, count(DISTINCT client_ip) AS unique_ips,
      count(DISTINCT path) AS unique_paths, bool_and(has_sec_fetch_headers) AS all_have_sec_fetch,
      bool_and(has_client_hints) AS all_have_hints,
      array_to_string(list_sort(list(DISTINCT client_ip))[1:3], ',') AS sample_ips,
      nullif(regexp_extract(asn_org, 'AS([0-9]+)', 1), '') AS asn_in_name
    FROM web WHERE {SUSPECT} GROUP BY asn_org""",
)
web("hosting_human_ips", f"SELECT asn_org, client_ip, count(*) AS request_count FROM web WHERE {SUSPECT} GROUP BY 1, 2")
web(
    "suspect_details",
    f"""SELECT client_ip, asn_org, has_sec_fetch_headers, has_client_hints, country, count(*) AS request_count,
      count(DISTINCT path) AS unique_paths, {arr('path')} AS all_paths, {arr('user_agent')} AS user_agents,
      {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen, {span()} AS duration_seconds,
      {rnd('count(*) / greatest(' + span() + ', 1.0)', 3)} AS req_per_sec
    FROM web WHERE {RES_HUMAN} AND {ilike_any('asn_org', R.ORG_PROXY_SELLERS)} GROUP BY 1, 2, 3, 4, 5
    ORDER BY request_count DESC, client_ip, asn_org, has_sec_fetch_headers NULLS FIRST, has_client_hints NULLS FIRST,
      country NULLS FIRST LIMIT 10""",
)
MODES = """modes AS (SELECT client_ip, min(user_agent) FILTER (WHERE ur = 1 AND user_agent IS NOT NULL) AS most_common_ua
    FROM (SELECT client_ip, user_agent, rank() OVER (PARTITION BY client_ip ORDER BY (user_agent IS NULL), count(*) DESC) AS ur
          FROM web GROUP BY client_ip, user_agent) GROUP BY 1),
  smodes AS (SELECT client_ip, min(site) AS most_visited_site
    FROM (SELECT client_ip, site, rank() OVER (PARTITION BY client_ip ORDER BY count(*) DESC) AS sr
          FROM web GROUP BY client_ip, site) WHERE sr = 1 GROUP BY 1)"""
PROFILE = f"""prof AS (SELECT client_ip, count(*) AS request_count, count(DISTINCT path) AS unique_paths,
    {span()} AS duration_seconds, {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
    count(*) FILTER (WHERE has_sec_fetch_headers) AS has_sec_fetch_count,
    count(*) FILTER (WHERE has_client_hints) AS has_client_hints_count,
    max(asn_org) AS asn_org, max(datacenter_provider) AS datacenter_provider, max(city) AS city, max(country) AS country,
    max(bot_classification) AS bot_classification, max(bot_name) AS bot_name,
    CASE WHEN {span()} > 0 THEN {rnd('count(*) / ' + span(), 4)} ELSE count(*)::DOUBLE END AS requests_per_second
  FROM web GROUP BY 1)"""
FULL = "full_profile AS (SELECT * FROM prof JOIN modes USING (client_ip) JOIN smodes USING (client_ip))"
web("ip_profile", "SELECT * FROM full_profile", PROFILE, MODES, FULL)
SF, CH, HRS = "(has_sec_fetch_count / request_count * 100)", "(has_client_hints_count / request_count * 100)", "(duration_seconds / 3600)"
SCORE = f"""greatest(0, least(100, 50
  + CASE WHEN requests_per_second < 0.05 THEN 25 WHEN requests_per_second < 0.2 THEN 15 ELSE -30 END
  + CASE WHEN {SF} > 90 THEN 30 WHEN {SF} > 50 THEN 15 ELSE -25 END
  + CASE WHEN {CH} > 90 THEN 20 WHEN {CH} > 50 THEN 10 ELSE -15 END
  + CASE WHEN datacenter_provider IS NOT NULL THEN -20 ELSE 15 END
  + CASE WHEN unique_paths > 5 THEN 10 WHEN unique_paths <= 2 THEN -10 ELSE 0 END
  + CASE WHEN {HRS} > 1 THEN 10 WHEN {HRS} < 0.05 THEN -10 ELSE 0 END))"""
web(
    "ip_verdicts",
    f"""SELECT * EXCLUDE (s), CAST(s AS BIGINT) AS legitimacy_score, CASE WHEN s >= 70 THEN 'LIKELY REAL HUMAN'
      WHEN s >= 40 THEN 'UNCERTAIN / POSSIBLE VPN USER' ELSE 'LIKELY BOT / AI TRAINING AGENT' END AS verdict,
      concat_ws(',',
        CASE WHEN requests_per_second < 0.05 THEN 'Very slow request rate (human-like)'
             WHEN requests_per_second < 0.2 THEN 'Moderate request rate' ELSE 'High request rate (bot-like)' END,
        CASE WHEN {SF} > 90 THEN 'Sec-Fetch headers present (real browser)' WHEN {SF} > 50 THEN 'Partial Sec-Fetch headers'
             ELSE 'Missing Sec-Fetch headers (likely bot)' END,
        CASE WHEN {CH} > 90 THEN 'Client Hints present (modern browser)' WHEN {CH} > 50 THEN 'Partial Client Hints'
             ELSE 'Missing Client Hints' END,
        CASE WHEN datacenter_provider IS NOT NULL THEN concat('Datacenter IP (', datacenter_provider, ')')
             ELSE 'Residential/ISP network' END,
        CASE WHEN unique_paths > 5 THEN 'Diverse path exploration (curious human)'
             WHEN unique_paths <= 2 THEN 'Narrow path targeting (bot-like)' END,
        CASE WHEN {HRS} > 1 THEN 'Extended session duration' WHEN {HRS} < 0.05 THEN 'Very short burst session' END
      ) AS indicators
    FROM (SELECT *, {SCORE} AS s FROM full_profile)""",
    PROFILE,
    MODES,
    FULL,
)
web(
    "sample_paths",
    "SELECT client_ip, array_to_string(list_sort(list(DISTINCT path))[1:10], ',') AS paths FROM web GROUP BY 1",
)
VISITOR = "client_ip, user_agent, has_sec_fetch_headers, has_client_hints, asn_org, country"
VORDER = ", ".join(f"{c.strip()} NULLS FIRST" for c in VISITOR.split(","))
FAST = f"""fast AS (SELECT {VISITOR}, count(*) AS request_count, count(DISTINCT path) AS unique_paths,
    {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen,
    {rnd('count(*) / ' + span(), 3)} AS req_per_sec
  FROM web WHERE {RES_HUMAN} AND {recent('30d')} GROUP BY ALL HAVING {span()} > 60 AND count(*) / {span()} > 0.5
  ORDER BY req_per_sec DESC, {VORDER} LIMIT 20)""".replace("GROUP BY ALL", f"GROUP BY {VISITOR}")
TRAVERSE = f"""trav AS (SELECT {VISITOR}, count(*) AS request_count, count(DISTINCT path) AS unique_paths,
    {rnd('count(DISTINCT path) / count(*)', 2)} AS path_diversity
  FROM web WHERE {RES_HUMAN} AND {recent('30d')} GROUP BY {VISITOR}
  HAVING count(DISTINCT path) > 50 OR count(DISTINCT path) / count(*) > 0.8
  ORDER BY unique_paths DESC, {VORDER} LIMIT 20)"""
SLEEPLESS = f"""act AS (SELECT client_ip, count(DISTINCT extract(hour FROM "timestamp")) AS hours_active,
    count(*) AS total_requests FROM web WHERE {RES_HUMAN} AND {recent('7d')} GROUP BY 1
  HAVING count(DISTINCT extract(hour FROM "timestamp")) > 18 AND count(*) > 50),
  firsts AS (SELECT DISTINCT ON (client_ip) client_ip, user_agent, asn_org, country FROM web
    WHERE bot_classification = 'human' ORDER BY client_ip, "timestamp", id),
  sleepless AS (SELECT client_ip, hours_active, total_requests, user_agent, asn_org, country
    FROM act JOIN firsts USING (client_ip) ORDER BY hours_active DESC, total_requests DESC, client_ip LIMIT 20)"""
web("too_fast_humans", "SELECT * FROM fast", FAST)
web("path_traversal", "SELECT * FROM trav", TRAVERSE)
web("sleepless_humans", "SELECT * FROM sleepless", SLEEPLESS)
web("residential_humans", f"SELECT count(*) AS count FROM web WHERE {RES_HUMAN} AND {recent('30d')}")
web(
    "suspicious_visitors",
    """SELECT (SELECT count(*) FROM fast) + (SELECT count(*) FROM trav) + (SELECT count(*) FROM sleepless) AS suspicious_count""",
    FAST,
    TRAVERSE,
    SLEEPLESS,
)
ORACLES["suspicious_visitors_listed"] = ORACLES["suspicious_visitors"]
ORACLES["suspicious_visitors"] = ORACLES["suspicious_visitors"].replace("LIMIT 20", "")
REVIEWED_IPS = f"client_ip IN {inside(DEFAULT.reviewed_ips)}"
web("reviewed_profiles", f"SELECT * FROM full_profile WHERE {REVIEWED_IPS}", PROFILE, MODES, FULL)
ORACLES["reviewed_paths"] = f"SELECT * FROM ({ORACLES['sample_paths']}) WHERE {REVIEWED_IPS}"

# --- Evidence as rows
def evidence(name: str, keys: str, value: str, condition: str, having: str, limit: int, time: str = "") -> None:
    """Requests per listed group and value; NULL values are no evidence."""
    columns = [k.strip() for k in keys.split(",")]
    order = ", ".join(f"{k} NULLS FIRST" for k in columns)
    same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM r.{k}" for k in columns)
    shown = ", ".join(f"r.{k}" if k != "time_bucket" else ts("r.time_bucket") + " AS time_bucket" for k in columns)
    web(
        name,
        f"""SELECT {shown}, r.{value}, count(*) AS count FROM rows r JOIN listed g ON {same}
        WHERE r.{value} IS NOT NULL GROUP BY ALL""",
        f"rows AS (SELECT *{time} FROM web WHERE {condition})",
        f"listed AS (SELECT {keys} FROM rows GROUP BY {keys} {having} ORDER BY count(*) DESC, {order} LIMIT {limit})",
    )


evidence(
    "burst_paths", "time_bucket, client_ip, subnet, bot_classification, datacenter_provider", "path", scope("6h"),
    "HAVING count(*) >= 20", 200, """, date_trunc('hour', "timestamp") AS time_bucket""",
)
_SUSPECTS = f"{RES_HUMAN} AND {ilike_any('asn_org', R.ORG_PROXY_SELLERS)}"
for _name, _value in (("suspect_paths", "path"), ("suspect_agents", "user_agent")):
    evidence(_name, "client_ip, asn_org, has_sec_fetch_headers, has_client_hints, country", _value, _SUSPECTS, "", 10)
evidence(
    "undetermined_ip_agents", "client_ip, datacenter_provider, country, asn_org, has_sec_fetch_headers, has_client_hints",
    "user_agent", UNDX, "", 20,
)
web("journey_sites", "SELECT subnet, replace(site, 'www.', '') AS site, count(*) AS count FROM web WHERE subnet IS NOT NULL GROUP BY 1, 2")
web("pattern_evidence", "SELECT client_ip, replace(site, 'www.', '') AS site, path, count(*) AS count FROM web GROUP BY 1, 2, 3")
PKEYS = "client_ip, user_agent, path, datacenter_provider, has_sec_fetch_headers, has_client_hints"
PORDER = ", ".join(f"{c.strip()} NULLS FIRST" for c in PKEYS.split(","))
PATTERNS = f"""pats AS (SELECT {PKEYS}, count(*) AS request_count FROM web WHERE {UNDX} GROUP BY {PKEYS}
  ORDER BY request_count DESC, {PORDER} LIMIT 500)"""
web("undetermined_patterns_top", "SELECT * FROM pats", PATTERNS)
web("undetermined_patterns", "SELECT * FROM pats", PATTERNS.replace("LIMIT 500", ""))

# --- Journeys
SITE = "replace(site, 'www.', '')"
JOURNEYS = f"""jl AS (SELECT subnet, bot_classification, bot_name FROM (SELECT subnet, bot_classification, bot_name,
      row_number() OVER (PARTITION BY subnet ORDER BY count(*) DESC, bot_classification NULLS FIRST, bot_name NULLS FIRST) AS r
      FROM web GROUP BY 1, 2, 3) WHERE r = 1),
  jr AS (SELECT subnet, CASE WHEN count(DISTINCT client_ip) = 1 THEN min(client_ip) END AS client_ip,
      {ts('min("timestamp")')} AS first_seen, {ts('max("timestamp")')} AS last_seen, {arr(SITE)} AS sites_visited,
      CASE WHEN bool_or({SITE} = '{THIRD}') THEN 3 WHEN bool_or({SITE} = '{SECOND}') THEN 2
           WHEN bool_or({SITE} = '{FIRST}') THEN 1 ELSE 0 END AS funnel_stage,
      count(*) AS total_requests, count(DISTINCT client_ip) AS unique_ips FROM web WHERE subnet IS NOT NULL GROUP BY 1),
  journeys AS (SELECT subnet, client_ip, first_seen, last_seen, sites_visited, CAST(funnel_stage AS BIGINT) AS funnel_stage,
      funnel_stage = 3 AS completed_funnel, total_requests, unique_ips, bot_classification, bot_name
    FROM jr JOIN jl USING (subnet) WHERE funnel_stage >= 1)"""
web("journeys", "SELECT * FROM journeys", JOURNEYS)
web(
    "funnel",
    """SELECT funnel_stage, count(*) AS journeys, CAST(sum(unique_ips) AS BIGINT) AS unique_ips FROM journeys GROUP BY 1""",
    JOURNEYS,
)
_PATTERN_ROWS = (
    """SELECT detected_at, client_ip, subnet, 'rapid_sequential' AS pattern_type,
      CAST(round(CAST(least(1.0, greatest(0.0, 0.5 + rate / 2)) AS DECIMAL(38,12)), 4) AS DOUBLE) AS confidence_score,
      request_count, CAST(floor(s) AS BIGINT) AS time_span_seconds, peak AS peak_requests, sites_visited, paths_accessed,
      'ai_stealth' AS suggested_classification
    FROM act WHERE rate > 0.5 OR peak > 20
    UNION ALL SELECT detected_at, client_ip, subnet, 'data_harvesting', CAST(round(CAST(div AS DECIMAL(38,12)), 4) AS DOUBLE),
      request_count, CAST(floor(s) AS BIGINT), peak AS peak_requests, sites_visited, paths_accessed, 'ai_stealth'
    FROM act WHERE paths > %d OR (div > %s AND request_count >= 20)
    UNION ALL SELECT detected_at, client_ip, subnet, 'cross_site_journey', CAST(round(CAST(stages / 3 AS DECIMAL(38,12)), 4) AS DOUBLE),
      request_count, CAST(floor(s) AS BIGINT), peak AS peak_requests, sites_visited, paths_accessed, NULL
    FROM act WHERE stages >= 2"""
    % (HARVEST_PATHS, HARVEST_DIVERSITY)
)
_ACT = f"""act AS (SELECT *, CASE WHEN s > 0 THEN request_count / s ELSE 0 END AS rate, paths / request_count AS div FROM (
      SELECT {ts('max("timestamp")')} AS detected_at, client_ip, min(subnet) AS subnet, count(*) AS request_count, {span()} AS s,
        count(DISTINCT path) AS paths, count(DISTINCT {SITE}) FILTER (WHERE {SITE} IN ('{FIRST}', '{SECOND}', '{THIRD}')) AS stages,
        {arr(SITE)} AS sites_visited, {arr('path')} AS paths_accessed, max(near) AS peak FROM near GROUP BY client_ip))"""


def near(seconds: int) -> str:
    return f"""near AS (SELECT *, count(*) OVER (PARTITION BY client_ip ORDER BY epoch_us("timestamp")
      RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS near FROM web)"""


web("behavior_patterns", _PATTERN_ROWS, near(120), _ACT)
web("behavior_pattern_rows", _PATTERN_ROWS.replace("sites_visited, paths_accessed, ", "").replace("sites_visited, paths_accessed,\n", ""), near(120), _ACT)
web(
    "peak_requests",
    f"""SELECT client_ip, max(near) AS peak, {ts('arg_max("timestamp", (near, -epoch_us("timestamp")))')} AS peak_at FROM near GROUP BY 1""",
    near(6 * 3600),
)
_EVENT_COLUMNS = """id, duration, client_ip, subnet, country, city, latitude, longitude, cf_ray, asn, asn_org,
  datacenter_provider, site, method, path, query_string, status, response_size, user_agent, has_sec_fetch_headers,
  has_client_hints, is_mobile, bot_classification, is_bot, bot_name, detection_level"""
web(
    "query_events",
    f"""SELECT {_EVENT_COLUMNS}, {ts('"timestamp"')} AS "timestamp" FROM web WHERE {recent('24h')}
      AND bot_classification IN ('human', 'web_crawler') AND method = 'GET'""",
)
web(
    "newest_events",
    f"""SELECT id, {ts('"timestamp"')} AS "timestamp", client_ip, path FROM web w WHERE status = 404
    ORDER BY w."timestamp" DESC, id LIMIT 50""",
)
DAY = 'CAST(CAST("timestamp" AS DATE) AS VARCHAR)'
web(
    "retained_days",
    f"""SELECT {DAY} AS event_date, count(*) AS count FROM web WHERE CAST("timestamp" AS DATE) > DATE '2024-01-21' GROUP BY 1""",
)

ORACLES["expired_table"] = ORACLES["retained_days"]

# --- Labels: the cascade over a relation ``sig`` of signals
def named(column: str, pairs) -> str:
    cases = []
    for name, pattern in pairs:
        if "(?!" in pattern:  # RE2 has no lookahead
            test = f"({column} ILIKE '%applebot%' AND {column} NOT ILIKE '%applebot-extended%')"
        else:
            test = f"regexp_matches({column}, '{re2(pattern)}', 'i')"
        cases.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(cases) + " END"


ROOTS = inside(R.ROOT_PATHS)
HEADLESS = f"({hit('ua', R.HEADLESS)} OR contains(ua, 'webdriver'))"
SHELL = f"({hit('path', R.SHELL_PATHS)} AND (" + " OR ".join(f"contains(lower(path), '{t}')" for t in R.SHELL_TERMS) + "))"
BROWSER = "(contains(ua, 'Mozilla') AND (" + " OR ".join(f"contains(ua, '{b}')" for b in R.BROWSER_ENGINES) + "))"
RULED = f"""ruled AS (SELECT *,
    CASE WHEN sf AND (ch OR html) AND prov IS NULL AND NOT coalesce(ua <> '' AND ({HEADLESS} OR drv), false) AND NOT fast THEN 'human'
      WHEN {hit('path', R.CMS_PATHS)} THEN 'cms' WHEN {SHELL} THEN 'shell'
      WHEN {hit('path', R.CONFIG_PATHS)} THEN 'config' WHEN {hit('path', R.EXPLOIT_PATHS)} THEN 'exploit'
      WHEN {hit('ua', R.AI_AGENTS)} THEN 'ai'
      WHEN {named('ua', R.CRAWLERS)} IS NOT NULL THEN 'crawler'
      WHEN {HEADLESS} THEN 'headless'
      WHEN {hit('ua', R.GENERIC_CRAWLER)} THEN 'generic'
      WHEN {hit('ua', [p for _, p in R.MONITORS])} THEN 'monitor'
      WHEN contains(path, '.well-known/cf-custom-hostname-challenge')
        OR regexp_matches(ua, 'Cloudflare.*Custom.*Hostname', 'i') THEN 'challenge'
      WHEN prov IS NOT NULL AND coalesce(ua, '') = '' AND path IN {ROOTS} THEN 'dc-monitor'
      WHEN prov IS NOT NULL AND coalesce(length(ua), 0) <= 50 AND path <> '' AND path NOT IN {ROOTS} THEN 'dc-crawler'
      WHEN prov IS NOT NULL AND {BROWSER} AND NOT sf THEN 'stealth'
      ELSE 'open' END AS rule FROM sig)"""
LABELLED = f"""lab AS (SELECT *,
    CASE rule WHEN 'human' THEN 'human' WHEN 'cms' THEN 'attack_wordpress_scanner' WHEN 'shell' THEN 'attack_webshell_scanner'
      WHEN 'config' THEN 'attack_config_scanner' WHEN 'exploit' THEN 'attack_exploit_attempt' WHEN 'ai' THEN 'ai_official'
      WHEN 'crawler' THEN 'web_crawler' WHEN 'headless' THEN 'web_crawler' WHEN 'generic' THEN 'web_crawler'
      WHEN 'monitor' THEN 'monitoring_service' WHEN 'challenge' THEN 'monitoring_service'
      WHEN 'dc-monitor' THEN 'monitoring_service' WHEN 'dc-crawler' THEN 'ai_stealth' WHEN 'stealth' THEN 'ai_stealth'
      ELSE 'bot_undetermined' END AS cls,
    CASE rule WHEN 'cms' THEN 'WordPress-Scanner' WHEN 'shell' THEN 'WebShell-Scanner' WHEN 'config' THEN 'Config-Scanner'
      WHEN 'exploit' THEN 'Exploit-Scanner' WHEN 'ai' THEN {named('ua', [(n, n) for n in R.AI_AGENTS])}
      WHEN 'crawler' THEN {named('ua', R.CRAWLERS)} WHEN 'headless' THEN 'Headless-Browser'
      WHEN 'generic' THEN 'Generic-Crawler' WHEN 'monitor' THEN {named('ua', R.MONITORS)}
      WHEN 'challenge' THEN 'Cloudflare-Verify' WHEN 'dc-monitor' THEN upper(prov) || '-Monitor'
      WHEN 'dc-crawler' THEN upper(prov) || '-Crawler' WHEN 'stealth' THEN upper(prov) || '-Stealth-AI'
      WHEN 'open' THEN 'Undetermined-Bot' END AS name,
    CAST(CASE WHEN rule IN ('cms', 'shell', 'config', 'exploit', 'ai', 'crawler', 'headless', 'generic') THEN 1
      WHEN rule IN ('monitor', 'challenge', 'dc-monitor', 'dc-crawler', 'stealth') THEN 2 WHEN rule = 'open' THEN 3 END AS BIGINT) AS lvl,
    CASE rule WHEN 'human' THEN 'Passed all human verification checks' WHEN 'cms' THEN 'WordPress vulnerability scanning'
      WHEN 'shell' THEN 'Web shell / backdoor scanning' WHEN 'config' THEN 'Configuration file / database scanner'
      WHEN 'exploit' THEN 'Active exploit attempt detected' WHEN 'ai' THEN 'Official AI bot declared in User-Agent'
      WHEN 'crawler' THEN 'Traditional web crawler' WHEN 'headless' THEN 'Headless browser automation detected'
      WHEN 'generic' THEN 'Generic bot/crawler pattern in User-Agent' WHEN 'monitor' THEN 'Uptime/monitoring service'
      WHEN 'challenge' THEN 'Cloudflare custom hostname verification'
      WHEN 'dc-monitor' THEN prov || ' availability check (no UA, simple path)'
      WHEN 'dc-crawler' THEN prov || ' datacenter + no UA + content path (systematic crawling)'
      WHEN 'stealth' THEN 'Datacenter + browser UA + missing Sec-Fetch headers'
      ELSE coalesce(nullif(concat_ws(', ', CASE WHEN coalesce(ua, '') = '' THEN 'No User-Agent' END, 'Datacenter: ' || prov,
             CASE WHEN NOT sfs THEN 'Missing Sec-Fetch headers' END), ''), 'Failed human verification checks') END AS reason
  FROM ruled)"""
SF_ON, CH_ON = "coalesce(has_sec_fetch_headers, false)", "coalesce(has_client_hints, false)"


def flags(source: str = "web", prov: str = "datacenter_provider") -> str:
    return f"""sig AS (SELECT *, user_agent AS ua, {prov} AS prov, {SF_ON} AS sf, {SF_ON} AS sfs, {CH_ON} AS ch, false AS html,
      false AS drv, false AS fast FROM {source})"""


def headers(source: str = "web", fast: str = "false", path: str = "path") -> str:
    return f"""sig AS (SELECT * EXCLUDE (path), {path} AS path, user_agent AS ua, datacenter_provider AS prov, {SF_ON} AS sf,
      {SF_ON} AND e % 4 <> 0 AS sfs, {CH_ON} AS ch, e % 2 = 0 AS html, e % 29 = 0 AS drv, {fast} AS fast FROM {source})"""


LAB = (RULED, LABELLED)
LABEL_ROW = """SELECT id, cls <> 'human' AS is_bot, cls AS bot_classification, name AS bot_name, lvl AS detection_level,
  reason AS detection_reason FROM lab"""
web("labels_from_flags", LABEL_ROW, flags(), *LAB)
web("labels_from_headers", LABEL_ROW, headers(), *LAB)
web(
    "labels_without_path",
    "SELECT cls AS bot_classification, name AS bot_name, reason AS detection_reason, count(*) AS count FROM lab GROUP BY 1, 2, 3",
    headers(path="CAST(NULL AS VARCHAR)"),
    *LAB,
)
SESS = f"""sess AS (SELECT client_ip, count(*) AS request_count, {span()} AS span_seconds FROM web WHERE {recent('7d')} GROUP BY 1)"""
web(
    "labels_with_sessions",
    "SELECT cls AS bot_classification, name AS bot_name, count(*) AS count FROM lab GROUP BY 1, 2",
    SESS,
    "joined AS (SELECT * FROM web LEFT JOIN sess USING (client_ip))",
    headers("joined", "coalesce(span_seconds > 0 AND request_count / span_seconds > 0.5, false)"),
    *LAB,
)
web("address_sessions", "SELECT * FROM sess", SESS)

V1 = f"""v1 AS (SELECT *, CASE
    WHEN {hit('user_agent', R.AI_AGENTS_V1)} THEN 'official_ai'
    WHEN {named('user_agent', R.CRAWLERS_V1)} IS NOT NULL OR {hit('user_agent', R.GENERIC_CRAWLER)} THEN 'web_crawler'
    WHEN datacenter_provider IS NOT NULL AND browser AND NOT bot_hdr THEN 'stealth_ai'
    WHEN datacenter_provider IS NOT NULL AND browser AND NOT {SF_ON} THEN 'ai_training' ELSE 'human' END AS cls
  FROM (SELECT *, regexp_matches(user_agent, 'Mozilla', 'i') AND {hit('user_agent', R.BROWSER_ENGINES)}
      AND NOT {hit('user_agent', R.BOT_WORDS)} AS browser,
      (e % 17 = 0 OR e % 19 = 0 OR coalesce(regexp_matches(user_agent, 'bot|crawler', 'i'), false)) AS bot_hdr
    FROM web JOIN (SELECT client_ip, count(*) AS n, {span()} AS s FROM web GROUP BY 1) USING (client_ip)))"""
web(
    "first_generation_labels",
    f"""SELECT cls <> 'human' AS is_bot, cls AS bot_classification,
      CASE cls WHEN 'official_ai' THEN {named('user_agent', [(x, x) for x in R.AI_AGENTS_V1])}
        WHEN 'web_crawler' THEN coalesce({named('user_agent', R.CRAWLERS_V1)}, 'Generic-Bot')
        WHEN 'stealth_ai' THEN upper(datacenter_provider) || '-Stealth'
        WHEN 'ai_training' THEN upper(datacenter_provider) || '-Training-Agent' END AS bot_name,
      CAST(CASE cls WHEN 'human' THEN NULL WHEN 'stealth_ai' THEN 2 WHEN 'ai_training' THEN 3 ELSE 1 END AS BIGINT) AS detection_level,
      count(*) AS count FROM v1 GROUP BY 1, 2, 3, 4""",
    V1,
)
web(
    "first_generation_reasons",
    """SELECT cls AS bot_classification, CASE WHEN cls <> 'ai_training' THEN NULL
        WHEN (s > 0 AND n / s > 0.5) OR (s < 120 AND n > 20) THEN 'Burst pattern'
        ELSE 'Datacenter IP + browser UA + missing Sec-Fetch headers' END AS reason_kind, count(*) AS count
    FROM v1 GROUP BY 1, 2""",
    V1,
)
web(
    "mapped_labels",
    f"""SELECT CASE bot_classification WHEN 'official_ai' THEN 'ai_official' WHEN 'stealth_ai' THEN 'ai_stealth'
        WHEN 'ai_training' THEN 'ai_stealth' ELSE bot_classification END AS mapped, {GROUP} AS traffic_group,
      {DISPLAY} AS display, {ATTACK} AS attack, count(*) AS count FROM web GROUP BY 1, 2, 3, 4""",
)
web("agent_families", f"SELECT {FAMILY} AS family, {REASON} AS reason, count(*) AS count FROM web GROUP BY 1, 2")


def provider(asn: str, org: str, extra: dict[int, str]) -> str:
    known = {**R.DATACENTER_ASNS, **extra}
    cases = " ".join(f"WHEN {n} THEN '{p}'" for n, p in known.items())
    words = "|".join(R.HOSTING_WORDS)
    return rf"coalesce(CASE {asn} {cases} END, CASE WHEN regexp_matches({org}, '\b({words})\b', 'i') THEN 'hosting' END)"


web(
    "provider_of_networks",
    f"""SELECT asn, asn_org, {provider('asn', 'asn_org', {64502: 'homelab'})} AS datacenter_provider, count(*) AS count
    FROM web GROUP BY 1, 2, 3""",
)
_KNOWN = {**R.DATACENTER_ASNS, 64502: "homelab", 8075: "azure-new"}
web(
    "known_networks",
    f"""SELECT asn, provider, count(*) AS count FROM web JOIN (VALUES
      {', '.join(f"({n}, '{p}')" for n, p in _KNOWN.items())}) d(n, provider) ON asn = n GROUP BY 1, 2""",
)

# --- Relabelling
CHANGED = "cls IS DISTINCT FROM bot_classification"
web(
    "full_rerun",
    f"""SELECT id, bot_classification AS old_class, cls AS new_class, cls AS bot_classification, name AS bot_name,
      lvl AS detection_level, cls <> 'human' AS is_bot FROM lab WHERE {CHANGED} OR name IS DISTINCT FROM bot_name""",
    flags(),
    *LAB,
)
web(
    "transitions",
    f"""SELECT bot_classification AS old_class, cls AS new_class, count(*) AS count FROM lab
    WHERE {CHANGED} OR name IS DISTINCT FROM bot_name GROUP BY 1, 2""",
    flags(),
    *LAB,
)
web(
    "applied_changes",
    f"""SELECT cls AS bot_classification, name AS bot_name,
      CASE WHEN {CHANGED} OR name IS DISTINCT FROM bot_name THEN lvl ELSE detection_level END AS detection_level,
      cls <> 'human' AS is_bot, count(*) AS count FROM lab GROUP BY 1, 2, 3, 4""",
    flags(),
    *LAB,
)
for _name in ("applied_in_place", "rewritten_days"):
    ORACLES[_name] = ORACLES["applied_changes"]
web(
    "relabelled_twice",
    f"""SELECT cls AS bot_classification, count(*) AS count, true AS refused_load, true AS refused FROM (
      SELECT CASE WHEN id % 2 = 0 THEN bot_classification WHEN id % 5 = 0 THEN 'stale' WHEN {DAY} >= '2024-01-15' THEN 'third'
        WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS cls FROM web WHERE id % 2 = 1 OR id % 4 = 0) GROUP BY 1""",
)
web(
    "undetermined_rerun",
    f"""SELECT id, bot_classification AS old_class, cls AS new_class, cls AS bot_classification, name AS bot_name,
      cls <> 'human' AS is_bot FROM lab WHERE {UND} AND client_ip NOT IN {XIP} AND {CHANGED}""",
    flags(),
    *LAB,
)
web(
    "training_agents",
    """SELECT id, bot_classification AS old_class, 'ai_training' AS new_class, 'ai_training' AS bot_classification,
      upper(p) || '-Training-Agent' AS bot_name, CAST(3 AS BIGINT) AS detection_level FROM web JOIN cand USING (client_ip)
    WHERE bot_classification = 'human' AND datacenter_provider IS NOT NULL AND has_sec_fetch_headers = false""",
    f"""cand AS (SELECT client_ip, min(datacenter_provider) AS p FROM web
      WHERE datacenter_provider IS NOT NULL AND bot_classification = 'human' AND ({NO_AGENT} OR (
        user_agent ILIKE '%Mozilla%' AND {ilike_any('user_agent', ('Chrome', 'Safari', 'Firefox'))}
        AND NOT {ilike_any('user_agent', ('bot', 'crawler', 'spider'))} AND has_sec_fetch_headers = false)) GROUP BY 1)""",
)
_MON = """SELECT id, bot_classification AS old_class, 'monitoring_service' AS new_class,
  'monitoring_service' AS bot_classification FROM """
web(
    "as_monitoring_top",
    f"""{_MON} lab l WHERE {UNDX} AND cls = 'monitoring_service' AND EXISTS (SELECT 1 FROM pats p WHERE
      p.client_ip = l.client_ip AND p.user_agent IS NOT DISTINCT FROM l.user_agent AND p.path = l.path
      AND p.datacenter_provider IS NOT DISTINCT FROM l.datacenter_provider
      AND p.has_sec_fetch_headers IS NOT DISTINCT FROM l.has_sec_fetch_headers
      AND p.has_client_hints IS NOT DISTINCT FROM l.has_client_hints)""",
    PATTERNS,
    flags(),
    *LAB,
)
web("as_monitoring", f"{_MON} lab WHERE {UNDX} AND cls = 'monitoring_service'", flags(), *LAB)


def step(n: int, rule: str, label: str, name: str, level: int, group: str | None = None) -> str:
    """One relabelling step over the labels the previous step left."""
    source = f"s{n - 1}"
    test = f"l = 'human' AND coalesce({rule}, false)"
    joined = source if group is None else f"{source} LEFT JOIN ({group.format(source)}) g USING (client_ip)"
    return f"""s{n} AS (SELECT id, client_ip, "timestamp", asn_org, datacenter_provider,
      CASE WHEN {test} THEN '{label}' ELSE l END AS l, CASE WHEN {test} THEN {name} ELSE nm END AS nm,
      CASE WHEN {test} THEN {level} ELSE lv END AS lv, chg OR {test} AS chg FROM {joined})"""


STEPS = (
    """s0 AS (SELECT id, client_ip, "timestamp", asn_org, datacenter_provider, bot_classification AS l, bot_name AS nm,
      detection_level AS lv, false AS chg FROM web)""",
    step(1, ilike_any("asn_org", R.ORG_CHEAP_HOSTS), "stealth_ai", "'Cheap-Hosting-Scraper'", 2),
    step(
        2,
        "hit",
        "stealth_ai",
        "'Burst-Pattern-Bot'",
        3,
        f"""SELECT client_ip, true AS hit FROM {{}} WHERE l = 'human' AND {recent('7d')} GROUP BY 1
          HAVING count(*) >= 5 AND {span()} > 0 AND count(*) / {span()} > 0.2""",
    ),
    step(
        3,
        "hit",
        "stealth_ai",
        "'Cloudflare-WARP-Bot'",
        2,
        f"""SELECT client_ip, true AS hit FROM {{}} WHERE l = 'human' AND asn_org = 'Cloudflare, Inc.'
          AND client_ip LIKE '2a06:98c0:%' GROUP BY 1 HAVING count(*) < 20 AND {span()} < 3600""",
    ),
    step(4, "asn_org ILIKE '%Tencent%'", "stealth_ai", "'Tencent-Cloud-Bot'", 2),
    step(
        5,
        "hit",
        "web_crawler",
        "'Corporate-Proxy-Crawler'",
        2,
        f"""SELECT client_ip, true AS hit FROM {{}} WHERE l = 'human' AND (asn_org ILIKE '%Kaspersky%'
          OR asn_org IN ('PJSC MegaFon', 'Rostelecom')) GROUP BY 1 HAVING count(*) >= 5 AND {span()} < 300""",
    ),
    step(
        6,
        "hit",
        "stealth_ai",
        "upper(p) || '-Stealth'",
        2,
        """SELECT client_ip, min(datacenter_provider) AS p, true AS hit FROM (SELECT client_ip, datacenter_provider FROM {}
          WHERE l = 'human' AND datacenter_provider IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1""",
    ),
)
web(
    "human_patterns",
    """SELECT id, 'human' AS old_class, l AS new_class, l AS bot_classification, nm AS bot_name, lv AS detection_level
    FROM s6 WHERE chg""",
    *STEPS,
)
NEW_ASNS = inside(R.NEW_HOSTING_ASNS)
web(
    "hosting_networks",
    f"""SELECT id, bot_classification AS old_class, nc AS new_class,
      CASE WHEN miss THEN 'hosting' ELSE datacenter_provider END AS datacenter_provider, nc AS bot_classification,
      CASE WHEN nc IS DISTINCT FROM bot_classification THEN nc <> 'human' ELSE is_bot END AS is_bot
    FROM (SELECT *, coalesce(datacenter_provider, '') = '' AS miss,
            CASE WHEN bot_classification = 'human' THEN cls ELSE bot_classification END AS nc FROM lab)
    WHERE asn IN {NEW_ASNS} AND (miss OR nc IS DISTINCT FROM bot_classification)""",
    flags(prov="'hosting'"),
    *LAB,
)


def expanded(name: str, source: str, *ctes: str) -> None:
    unsure = f"coalesce(bot_classification IN ('human', 'bot_undetermined'), false) AND {CHANGED}"
    web(
        name,
        f"""SELECT id, bot_classification AS old_class, CASE WHEN hit THEN cls ELSE bot_classification END AS new_class,
          prov AS datacenter_provider, CASE WHEN hit THEN cls ELSE bot_classification END AS bot_classification,
          CASE WHEN hit THEN name ELSE bot_name END AS bot_name,
          CASE WHEN hit THEN lvl ELSE detection_level END AS detection_level,
          CASE WHEN hit THEN cls <> 'human' ELSE is_bot END AS is_bot
        FROM (SELECT *, {unsure} AS hit FROM lab) WHERE prov IS NOT NULL""",
        *ctes,
        flags(source, "newprov"),
        *LAB,
    )


TODO = f"""todo AS (SELECT *, {provider('asn', 'asn_org', {})} AS newprov FROM web
  WHERE datacenter_provider IS NULL AND asn IS NOT NULL)"""
expanded("expanded_networks", "todo", TODO)
V4 = "(u > 1 AND u % 10 <> 9)"
FOUND = f"CASE WHEN {V4} THEN CAST(u % 8 + 1 AS INT) WHEN u % 20 = 19 THEN {B.WARP_NETWORK} END"
FOUND_NET = f"""fnet AS (SELECT *, CAST({pick([n[0] for n in B.NETWORKS], 'fi')} AS BIGINT) AS fasn, {pick([n[1] for n in B.NETWORKS], 'fi')} AS forg
  FROM (SELECT *, {FOUND} AS fi FROM web))"""
expanded(
    "expanded_networks_by_address",
    "todo",
    FOUND_NET,
    f"""todo AS (SELECT *, {provider('fasn', 'forg', {})} AS newprov FROM fnet
      WHERE datacenter_provider IS NULL AND asn IS NOT NULL)""",
)

# --- Lookups
web(
    "network_lookup",
    f"""SELECT id, client_ip, fasn AS asn, forg AS asn_org, {provider('fasn', 'forg', {})} AS datacenter_provider FROM fnet""",
    FOUND_NET,
)
ORACLES["prepared_lookup"] = ORACLES["network_lookup"]
A, Bb, Cc = "u % 4", "u % 8", "u % 250"
GEO = f"""geo AS (SELECT *,
    CASE WHEN {V4} THEN CASE WHEN {Cc} % 10 = 0 THEN 'HH' WHEN {Bb} % 2 = 0 THEN concat('A', {A}) ELSE 'ZZ' END
      WHEN u % 20 = 9 THEN CASE WHEN (u % 7 + u % 5) % 2 = 0 THEN 'VW' ELSE 'VV' END END AS gcountry,
    CASE WHEN {V4} THEN CASE WHEN {Cc} % 10 = 0 THEN concat('Host-', {Cc}) WHEN {Bb} % 2 = 0 THEN concat('City-', {A}, '-', {Bb}) END
      WHEN u % 20 = 9 AND (u % 7 + u % 5) % 2 = 0 THEN concat('Six-', u % 7, '-', u % 5) END AS gcity,
    nullif(CASE WHEN {V4} THEN CASE WHEN {Cc} % 10 = 0 THEN {Cc} WHEN {Bb} % 2 = 0 THEN {A} * 10 + {Bb} ELSE 1.5 END
      WHEN u % 20 = 9 THEN CASE WHEN (u % 7 + u % 5) % 2 = 0 THEN u % 7 ELSE 6.25 END END::DOUBLE, 0) AS glat,
    nullif(CASE WHEN {V4} THEN CASE WHEN {Cc} % 10 = 0 THEN -({Cc}) WHEN {Bb} % 2 = 0 THEN {Bb} - 90 ELSE 0 END
      WHEN u % 20 = 9 THEN CASE WHEN (u % 7 + u % 5) % 2 = 0 THEN u % 5 ELSE 7.75 END END::DOUBLE, 0) AS glon
  FROM {{}})"""
web(
    "geo_lookup",
    "SELECT id, client_ip, gcountry AS country, gcity AS city, glat AS latitude, glon AS longitude FROM geo",
    GEO.format("web"),
)
web(
    "geo_lookup_header_first",
    """SELECT coalesce(CASE WHEN e % 2 = 0 THEN 'DE' END, gcountry) AS country, gcity AS city, count(*) AS count
    FROM geo GROUP BY 1, 2""",
    GEO.format("web"),
)

# --- Parsing: what a line keeps of the event it was rendered from
GOOD = "e % 97 <> 0 AND e % 47 <> 0"
HOST = "CASE WHEN e % 53 <> 0 THEN site ELSE 'unknown' END"
MS = 'make_timestamp((epoch_us("timestamp") // 1000) * 1000)'
_AGENT = "nullif(user_agent, '')"


def parsed(extra: str) -> str:
    return f"""SELECT {ts(MS)} AS "timestamp", CASE WHEN e % 61 <> 0 THEN duration ELSE 0.0::DOUBLE END AS duration, client_ip, cf_ray,
      {HOST} AS site, CASE WHEN e % 59 <> 0 THEN method ELSE 'GET' END AS method, status,
      CASE WHEN e % 67 <> 0 THEN response_size ELSE 0 END AS response_size,
      CASE WHEN e % 5 = 0 THEN 'https://example.org/' END AS referer, {extra} FROM web WHERE {GOOD}"""


web(
    "parsed_requests",
    parsed(
        f"""path, query_string, CAST(NULL AS VARCHAR) AS content_type, {_AGENT} AS user_agent,
        CAST(NULL AS VARCHAR) AS accept_language"""
    ),
)
web(
    "historical_requests",
    parsed(
        f"""concat(path, CASE WHEN query_string IS NOT NULL THEN concat('?', query_string, '?rest') END) AS path,
        CAST(NULL AS VARCHAR) AS query_string, coalesce({_AGENT}, '') AS user_agent,
        CASE WHEN e % 2 = 0 THEN 'DE' END AS header_country"""
    )
    + f""" AND {HOST} IN {inside([FIRST, SECOND, THIRD, 'console.example.net', f'www.{FIRST}', f'www.{SECOND}',
        f'www.{THIRD}', 'www.console.example.net'])} AND (e % 3 = 0 OR e % 41 <> 5)""",
)
web(
    "odd_times",
    f"""SELECT e % 5 = 4 AS usable, CASE WHEN e % 5 = 4 THEN {DAY} ELSE 'bad' END AS day, count(*) AS count FROM web
    GROUP BY 1, 2""",
)
web(
    "records_of_days",
    f"""SELECT CAST(CAST({MS} AS DATE) AS VARCHAR) AS day, count(*) AS count FROM web WHERE {GOOD}
      AND {MS} >= TIMESTAMP '2024-01-10' AND {MS} < TIMESTAMP '2024-01-13' GROUP BY 1""",
)
web("bad_lines", "SELECT CAST(e AS VARCHAR) AS id FROM web WHERE e % 97 = 0")
web(
    "recent_records",
    f"""SELECT CAST(CAST({MS} AS DATE) AS VARCHAR) AS day, count(*) AS count FROM web WHERE {GOOD}
      AND {MS} >= TIMESTAMP '2024-01-20' GROUP BY 1""",
)
web(
    "proxy_addresses",
    """SELECT id, CASE e % 4 WHEN 0 THEN client_ip WHEN 1 THEN client_ip WHEN 2 THEN 'r-' || client_ip
      ELSE 's-' || client_ip END AS address FROM web""",
)
ORACLES["page_uris"] = r"""SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'www.', '') AS site,
  coalesce(nullif(split_part(rest, '?', 1), ''), '/') AS path, nullif(split_part(rest, '?', 2), '') AS query
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) AS rest FROM pages)"""
web(
    "address_subnets",
    """SELECT DISTINCT client_ip,
      CASE WHEN u % 20 = 19 AND u > 1 THEN concat('2a06:98c0:3600:', u % 9973, '::/64')
           WHEN u % 10 = 9 THEN concat('2001:db8:', u % 7, ':', u % 5, '::/64') ELSE subnet END AS as_written,
      CASE WHEN u % 20 = 19 THEN '2a06:98c0:3600:0::/64'
           WHEN u % 10 = 9 THEN concat('2001:db8:', u % 7, ':', u % 5, '::/64') ELSE subnet END AS expanded,
      CASE WHEN u % 20 = 19 THEN '2a06:9800::/24' WHEN u % 10 = 9 THEN '2001:d00::/24' ELSE subnet END AS network24
    FROM web""",
)
ANY_ATTACK = f"coalesce({hit('path', R.CMS_PATHS)} OR {SHELL} OR {hit('path', R.CONFIG_PATHS)} OR {hit('path', R.EXPLOIT_PATHS)}, false)"
web(
    "request_flags",
    f"""SELECT id, {SF_ON} AS sec_fetch_v1,
      ({' OR '.join(f"starts_with(path, '{p}')" for p in R.EXPLOIT_PREFIXES_V1)}) AS exploit_v1,
      ({SF_ON} OR e % 11 = 0) AS has_sec_fetch_headers, {CH_ON} AS has_client_hints, ({CH_ON} AND is_mobile) AS is_mobile,
      CASE WHEN e % 17 = 0 THEN 'bot@example.org' END AS bot_from_email,
      CASE WHEN e % 19 = 0 THEN concat('h', e % 7) END AS openai_host_hash, e % 23 = 0 AS has_cf_worker,
      CASE WHEN e % 23 = 0 THEN 'worker.example.net' END AS cf_worker_domain, {ANY_ATTACK} AS is_exploit_attempt FROM web""",
)

# --- Filters
SCANNER = hit("concat(path, CASE WHEN query_string IS NOT NULL THEN '?' || query_string END)", R.SCANNER_URIS)
WANTED = f"""client_ip <> {HOME} AND site NOT IN ('intranet.example.net', 'old.example.net', 'www.old.example.net')
  AND NOT {SCANNER}"""
web(
    "ingest_filters",
    f"""SELECT site, path, count(*) AS count FROM web WHERE {WANTED} AND client_ip NOT IN (
      SELECT client_ip FROM web WHERE client_ip LIKE '%7' AND e % 2 = 0) GROUP BY 1, 2""",
)
web(
    "unloaded_days",
    f"""SELECT {DAY} AS event_date, count(*) AS count FROM web WHERE CAST("timestamp" AS DATE) NOT IN (
      SELECT CAST("timestamp" AS DATE) FROM web WHERE day("timestamp") % 2 = 0 AND site = 'other.example.net') GROUP BY 1""",
)
web(
    "network_filters",
    f"""SELECT count(*) FILTER (WHERE {ilike_any('asn_org', R.ORG_SUSPECT)}) AS suspect,
      count(*) FILTER (WHERE {ilike_any('asn_org', R.ORG_PROXY_SELLERS)}) AS sellers,
      count(*) FILTER (WHERE {ilike_any('asn_org', R.ORG_CHEAP_HOSTS)}) AS cheap,
      count(*) FILTER (WHERE asn IN {NEW_ASNS}) AS new_hosting,
      count(*) FILTER (WHERE client_ip LIKE '2a06:98c0:%') AS warp FROM web""",
)
BUILT = f"""src AS (SELECT * EXCLUDE (site, "timestamp", datacenter_provider, user_agent), {HOST} AS site,
    {MS} AS "timestamp", {provider('fasn', 'forg', {})} AS datacenter_provider, {_AGENT} AS user_agent
  FROM fnet WHERE {GOOD}),
  kept AS (SELECT * FROM src WHERE {WANTED})"""
web(
    "built_events",
    f"""SELECT gcountry AS country, datacenter_provider, cls AS bot_classification, name AS bot_name,
      {ANY_ATTACK} AS is_exploit_attempt, count(*) AS count FROM lab GROUP BY 1, 2, 3, 4, 5""",
    FOUND_NET,
    BUILT,
    GEO.format("kept"),
    headers("geo"),
    *LAB,
)
web(
    "streamed_ingestion",
    "SELECT cls AS bot_classification, name AS bot_name, count(*) AS count FROM lab GROUP BY 1, 2",
    FOUND_NET,
    BUILT,
    headers("kept"),
    *LAB,
)
web(
    "kept_dashboard",
    f"""SELECT bot_classification, count(*) AS requests, count(DISTINCT client_ip) AS exact, true AS close FROM (
      SELECT client_ip, CASE WHEN {DAY} < '2024-01-05' THEN 'early' ELSE cls END AS bot_classification FROM lab) GROUP BY 1""",
    FOUND_NET,
    BUILT,
    headers("kept"),
    *LAB,
)

_MIDNIGHT = """date_trunc('day', "timestamp")"""
web(
    "ingested_session_labels",
    "SELECT cls AS bot_classification, name AS bot_name, count(*) AS count FROM lab GROUP BY 1, 2",
    f"""busy AS (SELECT * REPLACE (make_timestamp(epoch_us({_MIDNIGHT}) + (epoch_us("timestamp") - epoch_us({_MIDNIGHT})) // 8640) AS "timestamp")
      FROM web)""",
    FOUND_NET.replace("FROM web", "FROM busy"),
    BUILT,
    f"""paced AS (SELECT *, {span('min("timestamp") OVER day', 'max("timestamp") OVER day')} AS s, count(*) OVER day AS n
      FROM kept WINDOW day AS (PARTITION BY client_ip, {DAY}))""",
    headers("paced", "coalesce(s > 0 AND n / s > 0.5, false)"),
    *LAB,
)

web(
    "late_ingestion",
    f"SELECT {DAY} AS event_date, count(*) AS count FROM kept GROUP BY 1",
    FOUND_NET,
    BUILT,
)
ORACLES["pruned_ingestion"] = ORACLES["late_ingestion"]
web(
    "compacted_days",
    f"SELECT {DAY} AS event_date, count(*) AS count, CAST(1 AS BIGINT) AS directories FROM kept GROUP BY 1",
    FOUND_NET,
    BUILT,
)
web(
    "shared_table",
    f"""SELECT {DAY} AS event_date, true AS loaded, count(*) AS count FROM web WHERE e % 3 = 0 GROUP BY 1
    UNION ALL SELECT {DAY}, false, count(*) FROM kept WHERE e % 3 <> 0 GROUP BY 1""",
    FOUND_NET,
    BUILT,
)
web(
    "banned_ingestion",
    """SELECT 'kept' AS kind, count(*) AS count FROM kept
      WHERE client_ip NOT IN (SELECT client_ip FROM web WHERE client_ip LIKE '%7' AND e % 2 = 0)
    UNION ALL SELECT 'bad', count(*) FROM web WHERE e % 97 = 0""",
    FOUND_NET,
    BUILT,
)
web(
    "range_files",
    "SELECT gcountry AS country, fasn AS asn, forg AS asn_org, count(*) AS count FROM geo GROUP BY 1, 2, 3",
    FOUND_NET,
    GEO.format("fnet"),
)

# --- Text routing
_SCORES = [
    (
        topic,
        "("
        + f"CASE WHEN contains(t, '{name.lower()}') THEN 3 ELSE 0 END"
        + "".join(f" + CASE WHEN contains(t, '{w}') THEN 2 ELSE 0 END" for w in words)
        + ")",
    )
    for topic, name, words in R.REPORT_TOPICS
]
ORACLES["routed_text"] = (
    "SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN best > 0 AND s{i} = best THEN '{t}'" for i, (t, _) in enumerate(_SCORES))
    + " END AS report, CAST(best AS BIGINT) AS score FROM (SELECT *, greatest("
    + ", ".join(f"s{i}" for i in range(len(_SCORES)))
    + ") AS best FROM (SELECT conv_id, turn, "
    + ", ".join(f"{s} AS s{i}" for i, (_, s) in enumerate(_SCORES))
    + " FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)))"
)

# --- Sinks
_CLUSTERS = f"""clu AS (SELECT subnet, bot_classification, datacenter_provider, asn, asn_org, count(*) AS total_requests,
    count(DISTINCT client_ip) AS unique_ips, array_to_string(list_sort(list(DISTINCT country)
      FILTER (WHERE country IS NOT NULL)), '; ') AS countries
  FROM web WHERE {scope('7d')} GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 10
  ORDER BY total_requests DESC, subnet, bot_classification NULLS FIRST, datacenter_provider NULLS FIRST, asn NULLS FIRST,
    asn_org NULLS FIRST LIMIT 200)"""
web(
    "csv_export_rows",
    """SELECT subnet AS "Subnet", bot_classification AS "Bot Classification", datacenter_provider AS "Datacenter Provider",
      CAST(asn AS VARCHAR) AS "Asn", asn_org AS "Asn Org", CAST(total_requests AS VARCHAR) AS "Total Requests",
      CAST(unique_ips AS VARCHAR) AS "Unique Ips", countries AS "Countries" FROM clu""",
    _CLUSTERS,
)
_FIELD = "coalesce('\"' || replace(CAST({} AS VARCHAR), '\"', '\"\"') || '\"', '')"
_COLUMNS = ("subnet", "bot_classification", "datacenter_provider", "asn", "asn_org", "total_requests", "unique_ips", "countries")
web(
    "csv_export",
    """SELECT '"Subnet","Bot Classification","Datacenter Provider","Asn","Asn Org","Total Requests","Unique Ips","Countries"' AS value
    UNION ALL SELECT """
    + " || ',' || ".join(_FIELD.format(c) for c in _COLUMNS)
    + " FROM clu",
    _CLUSTERS,
)
web("sorted_report", "SELECT subnet, unique_ips, total_requests FROM clu", _CLUSTERS)
web(
    "progress_row",
    f"""SELECT {ts('max("timestamp")')} AS last_processed_timestamp, arg_max(cf_ray, "timestamp") AS last_cf_ray,
      count(*) AS records_processed FROM web""",
)
web("progress_mark", f"SELECT {ts('max(\"timestamp\")')} AS last_processed_timestamp FROM web")
web(
    "backfilled_columns",
    """SELECT count(path) AS n_path, CAST(0 AS BIGINT) AS n_query_string, CAST(0 AS BIGINT) AS n_is_mobile,
      CAST(0 AS BIGINT) AS n_has_client_hints, count(asn) AS n_asn, CAST(0 AS BIGINT) AS workers FROM web""",
)
web("stored_events", f"SELECT {DAY} AS event_date, count(*) AS count, count(DISTINCT id) AS ids FROM web GROUP BY 1")

# --- Streaming
web(
    "streamed_timeline",
    f"""SELECT {ts('d')} AS time_bucket, site, count, requests FROM (SELECT date_trunc('day', "timestamp")::TIMESTAMP AS d,
      {SITE} AS site, count(DISTINCT client_ip) AS count, count(*) AS requests FROM web GROUP BY 1, 2)""",
)
web(
    "streamed_sessions",
    f"""SELECT client_ip, {ts('min("timestamp")')} AS session_start, count(*) AS request_count, {span()} AS span_seconds
    FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY client_ip ORDER BY "timestamp", id) AS sid
      FROM (SELECT *, coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY client_ip ORDER BY "timestamp", id)
          > INTERVAL 30 MINUTE, true) AS gap FROM web))
    GROUP BY client_ip, sid""",
)
web(
    "streamed_unique",
    """SELECT site, status, count(*) AS count FROM (
      SELECT DISTINCT site, status, CASE WHEN e % 2 = 0 THEN cf_ray END, "timestamp", client_ip, path, query_string, method,
        response_size, duration, user_agent FROM web
      UNION ALL SELECT DISTINCT site, status + 1, CASE WHEN e % 2 = 0 THEN cf_ray END, "timestamp", client_ip, path,
        query_string, method, response_size, duration, concat(coalesce(user_agent, ''), '+') FROM web) GROUP BY 1, 2""",
)

# --- Search intelligence
QT, CAT, PRI = "concat('care ', e % 23)", "concat('cat-', e % 23 % 3)", "CASE WHEN e % 23 % 2 = 0 THEN 'high' ELSE 'normal' END"
SEARCH = f"""se AS (SELECT e AS search_id, {QT} AS query_text, {CAT} AS category, {PRI} AS priority, "timestamp" AS d,
    (e % 23 + e) % 4 < e % 23 % 5 AS ai, e % 6 = 0 AS place, e % 35 = 0 AS brand FROM web),
  op AS (SELECT {QT} AS query_text, CASE WHEN e % 2 = 0 THEN 'new' ELSE 'done' END AS status, path AS url FROM web WHERE status = 404),
  ci AS (SELECT e AS search_id, p AS position, concat('site', (e * p) % 37, '.example') AS domain
    FROM (SELECT e, unnest(generate_series(1, e % 8 + 1)) AS p FROM web)),
  og AS (SELECT domain, position + 2 AS position FROM ci WHERE position % 2 = 1 AND search_id % 3 = 0)"""
web(
    "search_overview",
    f"""SELECT count(*) AS total_searches, count(DISTINCT query_text) AS queries_tracked,
      count(*) FILTER (WHERE ai) AS ai_overviews_found, count(*) FILTER (WHERE place) AS place_mentions,
      count(*) FILTER (WHERE brand) AS brand_mentions, {ts('min(d)')} AS first_search_date, {ts('max(d)')} AS last_search_date,
      (SELECT count(*) FROM op) AS platform_opportunities,
      {pct('count(*) FILTER (WHERE ai)', 'count(*)', 1)} AS ai_overview_percentage FROM se""",
    SEARCH,
)
web(
    "search_queries",
    f"""SELECT *, CASE WHEN ai_percentage > 80 THEN 'high' WHEN ai_percentage > 50 THEN 'medium' ELSE 'low' END AS band FROM (
      SELECT query_text, category, priority, count(*) AS total_searches, count(*) FILTER (WHERE ai) AS ai_overview_count,
        {ts('max(d)')} AS last_search, coalesce(any_value(n), 0) AS opportunity_count,
        {pct('count(*) FILTER (WHERE ai)', 'count(*)', 0)} AS ai_percentage
      FROM se LEFT JOIN (SELECT query_text, count(*) AS n FROM op GROUP BY 1) USING (query_text) GROUP BY 1, 2, 3)""",
    SEARCH,
)
web(
    "ai_overviews",
    f"""SELECT search_id, query_text, {ts('d')} AS search_date, e8 AS citation_count,
      array_to_string((SELECT list(domain ORDER BY position) FROM ci WHERE ci.search_id = n.search_id)[1:5], ',') AS citations
    FROM (SELECT *, search_id % 8 + 1 AS e8 FROM se WHERE ai ORDER BY d DESC, search_id LIMIT 5) n""",
    SEARCH,
)
web(
    "citations_by_domain",
    f"""SELECT c.domain, citation_count, avg_position, avg_organic_position, avg_organic_position IS NOT NULL AS appears_in_organic
    FROM (SELECT domain, count(*) AS citation_count, {rnd('avg(position)', 1)} AS avg_position FROM ci GROUP BY 1
          ORDER BY citation_count DESC, domain LIMIT 20) c
    LEFT JOIN (SELECT domain, {rnd('avg(position)', 1)} AS avg_organic_position FROM og GROUP BY 1) o USING (domain)""",
    SEARCH,
)
web("new_opportunities", "SELECT query_text, url, count(*) AS count FROM op WHERE status = 'new' GROUP BY 1, 2", SEARCH)

# --- Row-local relabelling runs applied in place: the change sets above put over the rows
_BASE = "WITH " + WEB + " SELECT id, bot_classification FROM web"
ORACLES["row_jobs_in_place"] = " UNION ALL ".join(
    f"""SELECT '{job}' AS job, CASE WHEN c.id IS NULL THEN b.bot_classification ELSE c.bot_classification END AS bot_classification,
      count(*) AS count FROM ({_BASE}) b LEFT JOIN ({ORACLES[job]}) c ON b.id = c.id GROUP BY 1, 2"""
    for job in ("undetermined_rerun", "as_monitoring", "hosting_networks")
)

"""Every registered query: a library function applied to the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions import labels as L
from visitlens.functions import requests as R
from visitlens.functions import rules
from visitlens.functions.ip import subnet24, subnet_of
from visitlens.functions.metrics import requests
from visitlens.operators import changes as C
from visitlens.operators import filters as P
from visitlens.operators import reclassify as U
from visitlens.operators.bursts import peaks
from visitlens.operators.classify import classify_v1, classify_v2, unpack
from visitlens.operators.enrich import datacenter_provider, enrich, enrich_asn, enrich_geo
from visitlens.operators.ranges import networks, prepared
from visitlens.operators.scoring import route_text
from visitlens.operators.sessions import session_stats, with_session_stats
from visitlens.plans import dashboard as D
from visitlens.plans import explorer as X
from visitlens.plans import investigate as I
from visitlens.plans import journeys as J
from visitlens.plans import search as E
from visitlens.plans import summaries as S
from visitlens.plans import undetermined as N
from visitlens.sources import bindings as B
from visitlens.sources import dims, logs, sinks, upkeep
from visitlens.streaming import ingest as G
from visitlens.streaming import kept
from visitlens.streaming.scratch import shared_dir, staged

AS_OF = B.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable values: timestamps, dates and arrays as text, integers as long."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def on_web(name: str, fn, *args, **kwargs) -> None:
    """Registers a report over the web events."""
    QUERIES[name] = lambda spark, sf: plain(fn(B.web_events(spark, sf), *args, **kwargs))


def query(fn):
    """Registers a query of (spark, sf_dir) under its function's name."""
    QUERIES[fn.__name__] = lambda spark, sf: plain(fn(spark, sf))
    return fn


# Dashboard
on_web("overall_stats", D.overall_stats, AS_OF, "30d", on_topic=True)
on_web("overall_stats_day", D.overall_stats, AS_OF, "24h")
for _rng in ("6h", "24h", "7d", "30d"):
    on_web(f"timeline_{_rng}", D.timeline, AS_OF, _rng)
    on_web(f"filled_timeline_{_rng}", D.filled_timeline, AS_OF, _rng, on_topic=True)
on_web("classification_breakdown", D.classification_breakdown, AS_OF, "7d")
on_web("top_bots", D.top_bots, AS_OF, "30d", on_topic=True)
on_web("busiest_bots", D.busiest_bots, AS_OF, "30d", on_topic=True)
on_web("geo_heatmap", D.geo_heatmap, AS_OF, "30d")
on_web("coloured_heatmap", D.coloured_heatmap, AS_OF, "7d")


@query
def traffic_shares(spark, sf):
    return D.traffic_shares(D.overall_stats(B.web_events(spark, sf), AS_OF, "30d"))


@query
def dashboard_bundle(spark, sf):
    """The four frames of the front page as (frame, key, count) rows."""
    frames = D.dashboard(B.web_events(spark, sf), AS_OF, "7d")
    stats = frames["stats"].select(F.lit("stats").alias("frame"), F.lit("total").alias("key"), F.col("total_requests").alias("count"))
    line = frames["timeline"].groupBy("site").agg(F.sum("count").alias("count"))
    parts = [
        stats,
        line.select(F.lit("timeline").alias("frame"), F.col("site").alias("key"), "count"),
        frames["bot_classification"].select(F.lit("classes").alias("frame"), F.col("name").alias("key"), "count"),
        frames["top_bots"].select(F.lit("bots").alias("frame"), F.col("name").alias("key"), "count"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Explorer
on_web("subnet_clusters", X.subnet_clusters, AS_OF, "30d")
on_web("time_bursts", X.time_bursts, AS_OF, "6h", threshold=20)
on_web("datacenter_ips", X.datacenter_ips, AS_OF, "7d")
on_web("residential_patterns", X.residential_patterns, AS_OF, "30d")
on_web("asn_analysis", X.asn_analysis, AS_OF, "30d")
on_web("asn_analysis_current_labels", X.asn_analysis, AS_OF, "30d", labels="v2")
on_web("unique_ips", X.unique_ips, AS_OF, "30d")
on_web("busiest_ips", X.busiest_ips, AS_OF, "30d")
on_web("geographic_clusters", X.geographic_clusters, AS_OF, "30d")

# Summaries
on_web("bot_summary", S.bot_summary)
on_web("daily_stats", S.daily_stats)
on_web("class_counts", S.class_counts)
on_web("class_distribution", S.class_distribution)
on_web("class_distribution_one_digit", S.class_distribution, 1)
on_web("label_shares", S.label_shares, B.DEFAULT.excluded_ips)
on_web("metric_rows", S.metric_rows)
on_web("attack_breakdown", S.attack_breakdown)
on_web("human_checks", S.human_checks)
on_web("new_providers", S.new_providers)
on_web("traffic_groups", S.group_counts)
on_web("rows_between", S.rows_between, "2024-01-10 00:00:00", "2024-01-20 23:59:59.999")

# Undetermined traffic
on_web("undetermined_overview", N.overview)
on_web("undetermined_signals", N.signal_overview)
on_web("undetermined_agents", N.top_agents)
on_web("undetermined_by_provider", N.by_provider)
on_web("undetermined_active_ips", N.active_ips)
on_web("undetermined_paths", N.top_paths)
on_web("undetermined_by_hour", N.by_hour)
on_web("undetermined_by_country", N.by_country)
on_web("undetermined_behaviour", N.behaviour_profile)
on_web("undetermined_signal_ips", N.signal_ips)
on_web("undetermined_site_paths", N.site_paths)
on_web("undetermined_agent_families", N.agent_families)
on_web("undetermined_provider_counts", N.provider_counts)
on_web("undetermined_country_counts", N.country_counts)
on_web("undetermined_reasons", N.reasons)
on_web("undetermined_weekdays", N.by_weekday)
on_web("undetermined_fast_ips", N.fast_ips, AS_OF)

# Investigations
on_web("unlisted_orgs", I.unlisted_orgs)
on_web("org_category_listing", I.category_listing)
on_web("org_category_listing_cut", I.category_listing, {"hosting_vps": 1, "suspicious": 1})
on_web("org_category_listing_full", I.category_listing, {})
on_web("org_category_totals", I.category_totals)
on_web("hosting_humans", I.hosting_humans)
on_web("hosting_human_ips", I.hosting_human_ips)
on_web("suspect_details", I.suspect_details)
on_web("ip_profile", I.ip_profile, None)
on_web("ip_verdicts", I.ip_verdicts, None)
on_web("sample_paths", I.sample_paths, None)
on_web("too_fast_humans", I.too_fast_humans, AS_OF)
on_web("path_traversal", I.path_traversal, AS_OF)
on_web("sleepless_humans", I.sleepless_humans, AS_OF)
on_web("residential_humans", I.residential_humans, AS_OF)
on_web("suspicious_visitors", I.suspicious_visitors, AS_OF)
on_web("suspicious_visitors_listed", I.suspicious_visitors, AS_OF, limit=20)
on_web("undetermined_patterns", I.undetermined_patterns)
on_web("undetermined_patterns_top", I.undetermined_patterns, cap=500)
on_web("reviewed_profiles", I.ip_profile)
on_web("reviewed_paths", I.sample_paths)

# Evidence of listed groups as rows
on_web("burst_paths", X.burst_paths, AS_OF, "6h", threshold=20)
on_web("suspect_paths", I.suspect_evidence, "path")
on_web("suspect_agents", I.suspect_evidence, "user_agent")
on_web("undetermined_ip_agents", N.active_ip_agents)
on_web("journey_sites", J.journey_sites)
on_web("pattern_evidence", J.pattern_evidence)

# Journeys and declared tables
on_web("journeys", J.journeys)
on_web("funnel", J.funnel)
on_web("behavior_patterns", J.behavior_patterns, arrays=True)
on_web("behavior_pattern_rows", J.behavior_patterns)
on_web("peak_requests", peaks, 6 * 3600)
on_web("query_events", J.query_events, "24h", AS_OF, bot_classification=["human", "web_crawler"], method="GET")


@query
def newest_events(spark, sf):
    web = B.web_events(spark, sf)
    return J.query_events(web, limit=50, status=404).select("id", "timestamp", "client_ip", "path")


@query
def retained_days(spark, sf):
    stored = sinks.to_stored(B.web_events(spark, sf))
    return P.expire(stored, AS_OF, 10).groupBy("event_date").agg(requests())


# Relabelling
on_web("full_rerun", U.full_rerun)
on_web("undetermined_rerun", U.undetermined_rerun)
on_web("training_agents", U.training_agents)
on_web("as_monitoring", U.as_monitoring)
on_web("as_monitoring_top", U.as_monitoring, cap=500)
on_web("human_patterns", U.human_patterns, AS_OF)
on_web("hosting_networks", U.hosting_networks)
on_web("expanded_networks", U.expanded_networks)


@query
def expanded_networks_by_address(spark, sf):
    ranges = networks(B.asn_networks(spark, sf))
    return U.expanded_networks(B.web_events(spark, sf), ranges)


@query
def transitions(spark, sf):
    return C.transitions(U.full_rerun(B.web_events(spark, sf)))


@query
def applied_changes(spark, sf):
    """Labels after a full re-run has been written back."""
    web = B.web_events(spark, sf)
    after = C.apply_changes(web, U.full_rerun(web))
    return after.groupBy("bot_classification", "bot_name", "detection_level", "is_bot").agg(requests())


@query
def applied_in_place(spark, sf):
    """The same labels without a change set, as one pass over the rows."""
    after = U.applied(B.web_events(spark, sf), "full_rerun")
    return after.groupBy("bot_classification", "bot_name", "detection_level", "is_bot").agg(requests())


@query
def row_jobs_in_place(spark, sf):
    """Labels that the other row-local runs leave, one run at a time."""
    web, parts = B.web_events(spark, sf), None
    for job in ("undetermined_rerun", "as_monitoring", "hosting_networks"):
        after = U.applied(web, job).groupBy("bot_classification").agg(requests()).select(F.lit(job).alias("job"), "*")
        parts = after if parts is None else parts.unionByName(after)
    return parts


@query
def rewritten_days(spark, sf):
    """Two loads, a relabelling run that ends in the table, and its commit once more."""
    path, out = shared_dir(spark, "events"), shared_dir(spark, "patched")
    web = B.web_events(spark, sf)
    sinks.append_events(web.where("id % 2 = 0"), path, load_id=-1)
    sinks.append_events(web.where("id % 2 = 1"), path, load_id=-2)
    run = C.relabel(spark, path, U.full_rerun(sinks.read_events(spark, path)), out)
    C.commit_partitions(spark, run, path)
    after = sinks.read_events(spark, path)
    return after.groupBy("bot_classification", "bot_name", "detection_level", "is_bot").agg(requests())


@query
def relabelled_twice(spark, sf):
    """Runs that share a folder, one after the other, and one whose directories a load has replaced meanwhile."""
    path, out, web = shared_dir(spark, "events"), shared_dir(spark, "patched"), B.web_events(spark, sf)
    sinks.append_events(web.where("id % 2 = 0"), path, load_id=-1)
    sinks.append_events(web.where("id % 2 = 1"), path, load_id=-2)

    def changes(label, where):
        return sinks.read_events(spark, path).where(where).select(*C.ROW_KEYS, F.lit(label).alias("bot_classification"))

    C.relabel(spark, path, changes("first", "event_date < '2024-01-15'"), out)
    C.relabel(spark, path, changes("second", "event_date < '2024-01-15' and id % 3 = 0"), out)
    C.relabel(spark, path, changes("third", "event_date >= '2024-01-15'"), out)
    stale = C.rewrite_partitions(spark, path, changes("stale", "id % 5 = 0"), out)
    sinks.append_events(web.where("id % 4 = 0"), path, load_id=-1)
    refused = C.commit_partitions(spark, stale, path)
    after = sinks.read_events(spark, path).groupBy("bot_classification").agg(requests())
    days = {day for day, _ in refused}
    return after.select("*", F.lit(all(batch == -1 for _, batch in refused)).alias("refused_load"), F.lit(len(days) > 0).alias("refused"))


# Labels
@query
def labels_from_flags(spark, sf):
    df = unpack(classify_v2(B.web_events(spark, sf), headers="flags"))
    return df.select("id", "is_bot", "bot_classification", "bot_name", "detection_level", "detection_reason")


@query
def labels_from_headers(spark, sf):
    df = unpack(classify_v2(B.request_headers(B.web_events(spark, sf))))
    return df.select("id", "is_bot", "bot_classification", "bot_name", "detection_level", "detection_reason")


@query
def labels_without_path(spark, sf):
    df = unpack(classify_v2(B.request_headers(B.web_events(spark, sf)), path_aware=False))
    return df.groupBy("bot_classification", "bot_name", "detection_reason").agg(requests())


@query
def labels_with_sessions(spark, sf):
    df = with_session_stats(B.request_headers(B.web_events(spark, sf)), 7 * 24, AS_OF)
    return unpack(classify_v2(df)).groupBy("bot_classification", "bot_name").agg(requests())


@query
def first_generation_labels(spark, sf):
    df = unpack(classify_v1(with_session_stats(B.request_headers(B.web_events(spark, sf)))))
    return df.groupBy("is_bot", "bot_classification", "bot_name", "detection_level").agg(requests())


@query
def first_generation_reasons(spark, sf):
    """Behaviour rule by itself: no bot headers, so rows reach it only where the agent has none."""
    df = unpack(classify_v1(with_session_stats(B.request_headers(B.web_events(spark, sf)))))
    kind = F.split_part("detection_reason", F.lit(":"), F.lit(1))
    return df.groupBy("bot_classification", kind.alias("reason_kind")).agg(requests())


on_web("address_sessions", session_stats, 7 * 24, AS_OF)


@query
def mapped_labels(spark, sf):
    web = B.web_events(spark, sf)
    keys = (
        L.map_labels().alias("mapped"),
        L.traffic_group().alias("traffic_group"),
        L.display_class().alias("display"),
        L.is_attack().alias("attack"),
    )
    return web.groupBy(*keys).agg(requests())


@query
def agent_families(spark, sf):
    web = B.web_events(spark, sf)
    return web.groupBy(L.ua_family().alias("family"), L.undetermined_reason().alias("reason")).agg(requests())


@query
def provider_of_networks(spark, sf):
    web = B.web_events(spark, sf).drop("datacenter_provider")
    df = datacenter_provider(web, {64502: "homelab"})
    return df.groupBy("asn", "asn_org", "datacenter_provider").agg(requests())


@query
def known_networks(spark, sf):
    """Events per listed network, with an added entry."""
    known = dims.datacenter_asns(spark, {64502: "homelab", 8075: "azure-new"})
    return B.web_events(spark, sf).join(known, "asn").groupBy("asn", "provider").agg(requests())


# Parsing
@query
def parsed_requests(spark, sf):
    good, _ = logs.split_lines(B.raw_lines(B.web_events(spark, sf)))
    return logs.parse_logs(good).drop("headers")


@query
def historical_requests(spark, sf):
    good, _ = logs.split_lines(B.raw_lines(B.web_events(spark, sf)))
    df = logs.parse_logs(good.where(logs.is_access_log()), "backfill").drop("headers", "accept_language", "content_type")
    return P.keep_sites(df)


@query
def bad_lines(spark, sf):
    _, bad = logs.split_lines(B.raw_lines(B.web_events(spark, sf)))
    return bad.select(F.regexp_extract("line", "(?:cut off |ray-)([0-9]+)", 1).alias("id"))


@query
def odd_times(spark, sf):
    """Lines with times in other units, far ahead or before 1970: they are bad lines, and the rest is read."""
    e, ip = F.col("id"), F.col("client_ip")
    odd = F.when(e % 5 == 0, 1.7e12).when(e % 5 == 1, 1.7e15).when(e % 5 == 2, 1e17).when(e % 5 == 3, -1.0)
    seconds = F.coalesce(odd, F.unix_micros("timestamp") / 1e6).alias("ts")
    record = F.struct(F.lit("http.log.access.log0").alias("logger"), seconds, F.struct(ip.alias("client_ip")).alias("request"))
    read = logs.read_lines(B.web_events(spark, sf).select(F.to_json(record).alias("value")))
    day = F.coalesce(F.to_date(R.to_event_time(F.col("ts"))).cast("string"), F.lit("bad"))
    return read.groupBy("usable", day.alias("day")).agg(requests())


def _log_files(spark: SparkSession, sf: str) -> str:
    path = shared_dir(spark, "logs")
    B.raw_lines(B.web_events(spark, sf)).write.text(path)
    return path


@query
def recent_records(spark, sf):
    """The scan itself, from a progress mark on."""
    good, _ = logs.read_logs(spark, _log_files(spark, sf), since="2024-01-20 00:00:00")
    return good.groupBy(F.to_date(R.to_event_time(F.col("ts"))).alias("day")).agg(requests())


@query
def records_of_days(spark, sf):
    good = logs.read_logs_range(spark, _log_files(spark, sf), "2024-01-10", "2024-01-12")
    return good.groupBy(F.to_date(R.to_event_time(F.col("ts"))).alias("day")).agg(requests())


@query
def proxy_addresses(spark, sf):
    """Address chain of a request handler: edge header, first hop, real-ip header, socket."""
    e, ip = F.col("id"), F.col("client_ip")
    names = F.array(F.lit("cf-connecting-ip"), F.lit("x-forwarded-for"), F.lit("x-real-ip"))
    values = F.array(
        F.array(F.when(e % 4 == 0, ip).otherwise("")),
        F.array(F.when(e % 4 == 1, F.concat(F.lit(" "), ip, F.lit(" , 10.9.9.9"))).otherwise("")),
        F.array(F.when(e % 4 == 2, F.concat(F.lit("r-"), ip)).otherwise("")),
    )
    bag = F.map_from_arrays(names, values).alias("headers")
    request = F.struct(bag, F.concat(F.lit("s-"), ip).alias("remote_ip")).alias("request")
    return B.web_events(spark, sf).select("id", request).select("id", R.client_ip_expr("proxy").alias("address"))


@query
def page_uris(spark, sf):
    """Path and query of every page address, with its normalised host."""
    pages = B.table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path, query_text = R.split_uri(F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1))
    return pages.select("page_id", L.norm_site(host).alias("site"), path.alias("path"), query_text.alias("query"))


@query
def address_subnets(spark, sf):
    ips = B.web_events(spark, sf).select("client_ip").distinct()
    ip = F.col("client_ip")
    return ips.select(
        ip,
        subnet_of(ip).alias("as_written"),
        subnet_of(ip, strict=True).alias("expanded"),
        subnet24(ip).alias("network24"),
    )


@query
def request_flags(spark, sf):
    df = B.request_headers(B.web_events(spark, sf)).drop("is_mobile", "has_sec_fetch_headers", "has_client_hints")
    old = R.browser_signals(version=1)["has_sec_fetch_headers"].alias("sec_fetch_v1")
    old_exploit = R.security_flags(F.col("path"), version=1)["is_exploit_attempt"].alias("exploit_v1")
    flags = {**R.browser_signals(), **R.bot_headers(), **R.security_flags(F.col("path"))}
    return df.select("id", old, old_exploit, *[c.alias(n) for n, c in flags.items()])


# Filters
@query
def ingest_filters(spark, sf):
    web = B.web_events(spark, sf)
    kept = G.wanted(web, bans=dims.bans(B.ban_decisions(web)))
    return kept.groupBy("site", "path").agg(requests())


@query
def unloaded_days(spark, sf):
    new = sinks.to_stored(B.web_events(spark, sf))
    loaded = new.where("dayofmonth(event_date) % 2 = 0 and site = 'other.example.net'")
    return P.skip_loaded_days(new, loaded).groupBy("event_date").agg(requests())


@query
def network_filters(spark, sf):
    """Rows per network predicate of the relabelling runs."""
    web = B.web_events(spark, sf)
    return web.agg(
        F.count_if(P.org_like(rules.ORG_SUSPECT)).alias("suspect"),
        F.count_if(P.org_like(rules.ORG_PROXY_SELLERS)).alias("sellers"),
        F.count_if(P.org_like(rules.ORG_CHEAP_HOSTS)).alias("cheap"),
        F.count_if(P.asn_in(rules.NEW_HOSTING_ASNS)).alias("new_hosting"),
        F.count_if(P.ip_prefix(rules.WARP_PREFIX)).alias("warp"),
    )


# Lookups
@query
def geo_lookup(spark, sf):
    web = B.web_events(spark, sf).select("id", "client_ip")
    return enrich_geo(web, networks(B.geo_networks(spark, sf)))


@query
def geo_lookup_header_first(spark, sf):
    header = F.when(F.col("id") % 2 == 0, F.lit("DE")).alias("header_country")
    web = B.web_events(spark, sf).select("id", "client_ip", header)
    found = enrich_geo(web, networks(B.geo_networks(spark, sf)), prefer_header=True)
    return found.groupBy("country", "city").agg(requests())


@query
def network_lookup(spark, sf):
    web = B.web_events(spark, sf).select("id", "client_ip")
    return enrich_asn(web, networks(B.asn_networks(spark, sf)))


@query
def prepared_lookup(spark, sf):
    """The same by a table that was flattened beforehand."""
    web = B.web_events(spark, sf).select("id", "client_ip")
    return enrich_asn(web, prepared(networks(B.asn_networks(spark, sf))))


@query
def range_files(spark, sf):
    """Both network tables written, read back by their readers and used for the lookups."""
    path = shared_dir(spark, "ranges")
    B.geo_networks(spark, sf).write.parquet(f"{path}/geo")
    B.asn_networks(spark, sf).write.option("header", True).csv(f"{path}/asn.csv")
    web = B.web_events(spark, sf).select("id", "client_ip")
    found = enrich(web, dims.read_geo_ranges(spark, f"{path}/geo"), dims.read_asn_ranges(spark, f"{path}/asn.csv"))
    return found.groupBy("country", "asn", "asn_org").agg(requests())


@query
def built_events(spark, sf):
    """Log lines all the way to labelled events; they are parsed once."""
    good, _ = logs.split_lines(B.raw_lines(B.web_events(spark, sf)))
    parsed = staged(G.wanted(logs.parse_logs(good)), "parsed")
    events = G.build_events(parsed, networks(B.geo_networks(spark, sf)), networks(B.asn_networks(spark, sf)))
    keys = ("country", "datacenter_provider", "bot_classification", "bot_name", "is_exploit_attempt")
    return sinks.to_stored(events).groupBy(*keys).agg(requests())


@query
def routed_text(spark, sf):
    return route_text(B.table(spark, sf, "conversations")).select("conv_id", "turn", "report", "score")


# Sinks
@query
def csv_export_rows(spark, sf):
    return sinks.csv_ready(X.subnet_clusters(B.web_events(spark, sf), AS_OF, "7d"))


@query
def csv_export(spark, sf):
    """The lines of the written CSV file."""
    path = shared_dir(spark, "csv")
    sinks.export_csv(X.subnet_clusters(B.web_events(spark, sf), AS_OF, "7d"), path)
    return spark.read.text(path)


@query
def progress_row(spark, sf):
    row = sinks.batch_metrics(B.web_events(spark, sf))
    return row.select("last_processed_timestamp", "last_cf_ray", "records_processed")


@query
def progress_mark(spark, sf):
    """Newest of one progress row per day."""
    days = B.web_events(spark, sf).groupBy(F.to_date("timestamp").alias("d"))
    state = days.agg(F.max("timestamp").alias("last_processed_timestamp")).withColumn("created_at", F.col("d"))
    return dims.last_mark(state)


@query
def backfilled_columns(spark, sf):
    """What a historical load leaves empty."""
    df = sinks.to_backfilled(B.web_events(spark, sf))
    return df.agg(
        *[F.count(c).alias(f"n_{c}") for c in ("path", "query_string", "is_mobile", "has_client_hints", "asn")],
        F.count_if("has_cf_worker").alias("workers"),
    )


@query
def stored_events(spark, sf):
    """Events written to the partitioned table and read back, per day."""
    path = shared_dir(spark, "events")
    sinks.append_events(B.web_events(spark, sf), path)
    return spark.read.parquet(path).groupBy("event_date").agg(requests(), F.count_distinct("id").alias("ids"))


@query
def sorted_report(spark, sf):
    report = X.subnet_clusters(B.web_events(spark, sf), AS_OF, "7d")
    return sinks.sort_for_display(report, "unique_ips").select("subnet", "unique_ips", "total_requests")


# Streaming
def _web_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.readStream.schema(B.table(spark, sf, "events").schema)
    return B.web_from(raw.option("pathGlobFilter", "events.parquet").parquet(sf))


def _drain(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    path = shared_dir(spark, name)
    writer = df.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query
def streamed_timeline(spark, sf):
    """Windows the stream has closed, completed by those still open at the end of the input."""
    out = _drain(G.timeline_stream(_web_stream(spark, sf), "1 day"), spark, "timeline")
    return G.with_open(out, G.timeline_stream(B.web_events(spark, sf), "1 day"), ["time_bucket", "site"])


@query
def streamed_sessions(spark, sf):
    out = _drain(G.sessions_stream(_web_stream(spark, sf), "30 minutes"), spark, "sessions")
    return G.with_open(out, G.sessions_stream(B.web_events(spark, sf), "30 minutes"), ["client_ip", "session_start"])


@query
def streamed_unique(spark, sf):
    """Every event sent twice, and once more without a ray id and with another status and agent: two are left."""
    thrice = _web_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))))
    other = F.col("copy") > 2
    thrice = thrice.withColumns(
        {
            "cf_ray": F.when(F.col("id") % 2 == 0, F.col("cf_ray")),
            "status": F.when(other, F.col("status") + 1).otherwise(F.col("status")),
            "user_agent": F.when(other, F.concat(F.coalesce("user_agent", F.lit("")), F.lit("+"))).otherwise(F.col("user_agent")),
        }
    )
    keyed = thrice.withColumn("event", F.col("id")).withColumn("id", R.event_key([*thrice.columns, "event"]))
    out = _drain(G.dedup_stream(keyed, delay="60 days").select("event", "site", "status"), spark, "unique")
    return out.groupBy("site", "status").agg(requests())


@query
def streamed_ingestion(spark, sf):
    """Log files through the ingestion stream into the events table."""
    root = shared_dir(spark, "ingest")
    B.raw_lines(B.web_events(spark, sf)).write.text(f"{root}/logs")
    job = G.Ingestion(
        events_path=f"{root}/events",
        progress_path=f"{root}/progress",
        checkpoint=f"{root}/state",
        geo=networks(B.geo_networks(spark, sf)),
        networks=networks(B.asn_networks(spark, sf)),
    )
    G.ingest_stream(spark, f"{root}/logs", job).awaitTermination()
    return sinks.read_events(spark, job.events_path).groupBy("bot_classification", "bot_name").agg(requests())


def _job(spark: SparkSession, sf: str, root: str, **more) -> G.Ingestion:
    geo, asn = prepared(networks(B.geo_networks(spark, sf)), "geo"), prepared(networks(B.asn_networks(spark, sf)))
    return G.Ingestion(f"{root}/events", f"{root}/progress", f"{root}/state", geo, asn, **more)


def _take(spark: SparkSession, lines: DataFrame, root: str, job: G.Ingestion) -> None:
    """Adds a log, as many files as its lines have parts, and ingests it as one batch."""
    lines.write.mode("append").text(f"{root}/logs")
    G.ingest_stream(spark, f"{root}/logs", job).awaitTermination()


@query
def banned_ingestion(spark, sf):
    """Ingestion with a ban list, and its bad lines set aside."""
    root, web = shared_dir(spark, "ingest"), B.web_events(spark, sf)
    B.raw_lines(web).write.text(f"{root}/logs")
    bans = B.ban_decisions(web).agg(F.to_json(F.sort_array(F.collect_set(F.struct("value")))).alias("value"))
    bans.coalesce(1).write.text(f"{root}/bans")
    job = _job(spark, sf, root, bans_path=f"{root}/bans", bad_path=f"{root}/bad")
    G.ingest_stream(spark, f"{root}/logs", job).awaitTermination()
    kept = sinks.read_events(spark, job.events_path).agg(F.lit("kept").alias("kind"), requests())
    return kept.unionByName(spark.read.text(job.bad_path).agg(F.lit("bad").alias("kind"), requests()))


@query
def late_ingestion(spark, sf):
    """Three logs, one a batch, each older than the one before, and the first once more: all stored, once."""
    root, web = shared_dir(spark, "late"), B.spread_events(spark, sf)
    days = ("timestamp >= '2024-01-20'", "timestamp >= '2024-01-10' and timestamp < '2024-01-20'", "timestamp < '2024-01-10'")
    job = _job(spark, sf, root)
    for part in (*days, days[0]):
        _take(spark, B.raw_lines(web.where(part)), root, job)
    return sinks.read_events(spark, job.events_path).groupBy("event_date").agg(requests())


@query
def pruned_ingestion(spark, sf):
    """Four logs, one a batch, the last with rows of all others; a batch reads directories that share a second with it."""
    root, web = shared_dir(spark, "pruned"), B.spread_events(spark, sf)
    job = _job(spark, sf, root, times_path=f"{root}/times")
    for part in ("id % 3 = 0", "id % 3 = 1", "id % 2 = 0", "id % 3 = 2 or id % 5 = 0"):
        _take(spark, B.raw_lines(web.where(part)), root, job)
    return sinks.read_events(spark, job.events_path).groupBy("event_date").agg(requests())


@query
def shared_table(spark, sf):
    """One table that a load, the stream, a relabelling run and the stream again have written, read in one go."""
    root, web = shared_dir(spark, "shared"), B.web_events(spark, sf)
    job = _job(spark, sf, root)
    for _ in range(2):
        sinks.append_events(web.where("id % 3 = 0"), job.events_path, load_id=-1)
    _take(spark, B.raw_lines(web.where("id % 3 = 1")), root, job)
    C.relabel(spark, job.events_path, U.full_rerun(sinks.read_events(spark, job.events_path)), f"{root}/patched")
    _take(spark, B.raw_lines(web.where("id % 3 = 2")), root, job)
    loaded = (F.col("batch_id") < 0).alias("loaded")
    return sinks.read_events(spark, job.events_path).groupBy("event_date", loaded).agg(requests())


@query
def compacted_days(spark, sf):
    """Ten batches of the stream, compacted, the same files once more and a late file, compacted again: rows and directories."""
    root, web = shared_dir(spark, "compact"), B.spread_events(spark, sf)
    job = _job(spark, sf, root)
    lines = B.raw_lines(web.where("id % 4 != 0"))
    for part in range(3):
        _take(spark, lines.where(F.pmod(F.xxhash64("value"), F.lit(3)) == part), root, job)
    path = job.events_path
    upkeep.compact(spark, path, f"{root}/runs", upkeep.stored_days(spark, path))
    _take(spark, lines, root, job)
    _take(spark, B.raw_lines(web.where("id % 4 = 0")), root, job)
    run = upkeep.compact(spark, path, f"{root}/runs", upkeep.stored_days(spark, path))
    upkeep.commit_merged(spark, run, path)
    rows = sinks.read_events(spark, path).groupBy("event_date").agg(requests(), F.countDistinct("batch_id").alias("directories"))
    return rows


@query
def kept_dashboard(spark, sf):
    """Requests and visitors by label from kept aggregates, after late files, compaction and a relabelling run."""
    root, web = shared_dir(spark, "kept"), B.spread_events(spark, sf)
    job = _job(spark, sf, root, kept_path=f"{root}/kept")
    for part in ("timestamp >= '2024-01-12'", "timestamp < '2024-01-12'", "id % 2 = 0"):
        _take(spark, B.raw_lines(web.where(part)), root, job)
    path = job.events_path
    days = upkeep.stored_days(spark, path)
    upkeep.compact(spark, path, f"{root}/runs", days[:9])
    changes = sinks.read_events(spark, path).where("event_date < '2024-01-05'")
    C.relabel(spark, path, changes.select(*C.ROW_KEYS, F.lit("early").alias("bot_classification")), f"{root}/runs")
    kept.rebuild(spark, path, job.kept_path, days[:9])
    parts = kept.read_parts(spark, job.kept_path)
    exact = sinks.read_events(spark, path).groupBy("bot_classification").agg(F.countDistinct("client_ip").alias("exact"))
    found = kept.summed(parts, ["bot_classification"], "2024-01-01 00:00:00", "2025-01-01 00:00:00").join(exact, "bot_classification")
    close = F.abs(F.col("visitors") - F.col("exact")) <= 0.03 * F.col("exact")
    return found.select("bot_classification", "requests", "exact", close.alias("close"))


@query
def ingested_session_labels(spark, sf):
    """Labels of a stream whose rate rules see all batches; a day's requests come within ten seconds, in five batches."""
    root, web = shared_dir(spark, "rates"), B.spread_events(spark, sf)
    day = F.date_trunc("day", "timestamp")
    within = F.unix_micros("timestamp") - F.unix_micros(day)
    web = web.withColumn("timestamp", F.timestamp_micros(F.unix_micros(day) + F.floor(within / 8640)))
    job = _job(spark, sf, root, activity_path=f"{root}/activity")
    for part in range(5):
        _take(spark, B.raw_lines(web.where(F.col("id") * 7 % 5 == part)), root, job)
    return sinks.read_events(spark, job.events_path).groupBy("bot_classification", "bot_name").agg(requests())


@query
def expired_table(spark, sf):
    """A table after days outside the retention period were removed, twice."""
    path, web = shared_dir(spark, "expire"), B.web_events(spark, sf)
    sinks.append_events(web, path, load_id=-1)
    for _ in range(2):
        upkeep.expire_days(spark, path, AS_OF, days=10)
    return sinks.read_events(spark, path).groupBy("event_date").agg(requests())


# Search intelligence, over searches derived from the events
def _searches(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    web = B.web_events(spark, sf).select("id", "timestamp", "path", "client_ip", "status")
    e = F.col("id")
    searches = web.select(
        e.alias("search_id"),
        F.concat(F.lit("care "), (e % 23).cast("string")).alias("query_text"),
        F.concat(F.lit("cat-"), (e % 23 % 3).cast("string")).alias("category"),
        F.when(e % 23 % 2 == 0, "high").otherwise("normal").alias("priority"),
        F.col("timestamp").alias("search_date"),
        ((e % 23 + e) % 4 < e % 23 % 5).alias("has_ai_overview"),
        (e % 6 == 0).alias("mentions_place"),
        (e % 35 == 0).alias("mentions_brand"),
    )
    positions = web.select("id", F.explode(F.sequence(F.lit(1), (e % 8 + 1).cast("int"))).alias("position"))
    domain = F.concat(F.lit("site"), ((F.col("id") * F.col("position")) % 37).cast("string"), F.lit(".example"))
    cited = positions.select(F.col("id").alias("search_id"), "position", domain.alias("domain"))
    organic = cited.where("position % 2 = 1 and search_id % 3 = 0").withColumn("position", F.col("position") + 2)
    found = web.where("status = 404").select(
        F.concat(F.lit("care "), (e % 23).cast("string")).alias("query_text"),
        F.when(e % 2 == 0, "new").otherwise("done").alias("status"),
        F.col("path").alias("url"),
    )
    return {"searches": searches, "citations": cited, "organic": organic, "opportunities": found}


@query
def search_overview(spark, sf):
    s = _searches(spark, sf)
    return E.search_overview(s["searches"], s["opportunities"])


@query
def search_queries(spark, sf):
    s = _searches(spark, sf)
    return E.search_queries(s["searches"], s["opportunities"])


@query
def ai_overviews(spark, sf):
    s = _searches(spark, sf)
    return E.ai_overviews(s["searches"], s["citations"])


@query
def citations_by_domain(spark, sf):
    s = _searches(spark, sf)
    return E.citations_by_domain(s["citations"], s["organic"])


@query
def new_opportunities(spark, sf):
    found = _searches(spark, sf)["opportunities"]
    return E.opportunities_by_status(found).groupBy("query_text", "url").agg(requests())

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitlens.functions.labels import asn_from_org, funnel_stage, norm_site
from visitlens.functions.metrics import req_rate
from visitlens.operators.ranges import networks
from visitlens.operators.reclassify import as_monitoring, human_patterns, training_agents
from visitlens.operators.scoring import dominant_class, route_text
from visitlens.plans import backfill, dashboard, explorer, journeys, summaries
from visitlens.settings import DEFAULT
from visitlens.sources.bindings import AS_OF, web_events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def web(spark):
    return web_events(spark, SF).cache()


def test_empty_range_has_no_timeline(web):
    assert dashboard.filled_timeline(web, "2020-01-01 00:00:00", "24h").count() == 0


def test_every_site_gets_every_bucket(web):
    rows = dashboard.filled_timeline(web, AS_OF, "30d").collect()
    per_site = {s: [r.time_bucket for r in rows if r.site == s] for s in DEFAULT.funnel_sites}
    assert len({tuple(sorted(v)) for v in per_site.values()}) == 1
    days = sorted(next(iter(per_site.values())))
    assert all(b - a == dt.timedelta(days=1) for a, b in zip(days, days[1:]))


def test_missing_label_is_unknown(web):
    nulls = web.where("bot_classification is null").count()
    row = dashboard.classification_breakdown(web, AS_OF, "30d").where("name = 'Unknown'").first()
    assert nulls > 0 and row["count"] > 0


def test_attack_wildcard_needs_one_character(spark):
    from visitlens.functions.labels import is_attack

    df = spark.createDataFrame([("attack_x",), ("attackx1",), ("attack",), ("attack_",)], "bot_classification string")
    assert [r[0] for r in df.select(is_attack()).collect()] == [True, True, False, True]


def test_first_generation_labels_vanish_on_new_data(web):
    new = web.where("coalesce(bot_classification, '') not in ('official_ai', 'stealth_ai')")
    old_names = explorer.asn_analysis(new, AS_OF, "30d").agg(F.sum("official_ai_count"), F.sum("stealth_ai_count")).first()
    new_names = explorer.asn_analysis(new, AS_OF, "30d", labels="v2").agg(F.sum("official_ai_count")).first()
    assert tuple(old_names) == (0, 0) and new_names[0] > 0


def test_no_countries_is_null_not_empty(web):
    rows = explorer.subnet_clusters(web.withColumn("country", F.lit(None).cast("string")), AS_OF, "30d", 1).collect()
    assert rows and all(r.countries is None for r in rows)


def test_rates(spark):
    df = spark.createDataFrame([(10, 4.0), (10, 0.0), (1, 0.25)], "n long, s double")
    got = df.select(req_rate("n", "s"), req_rate("n", "s", "null"), req_rate("n", "s", "floor")).collect()
    assert [tuple(r) for r in got] == [(2.5, 2.5, 2.5), (10.0, None, 10.0), (4.0, 4.0, 1.0)]


def test_small_labels(spark):
    first, second, third = DEFAULT.funnel_sites
    rows = [([first],), ([first, second],), ([third],), (["x"],), ([],)]
    df = spark.createDataFrame(rows, "s array<string>")
    assert [r[0] for r in df.select(funnel_stage("s")).collect()] == [1, 2, 3, 0, 0]
    one = spark.createDataFrame([("AS64501 X", "www.a.www.b")], "o string, site string")
    assert tuple(one.select(asn_from_org("o"), norm_site()).first()) == ("64501", "a.b")


def test_dominant_class_ties_and_default(spark):
    names = ("human_count", "official_ai_count", "stealth_ai_count", "web_crawler_count", "monitoring_count")
    df = spark.createDataFrame([(1, 1, 0, 0, 0), (0, 0, 2, 2, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 9)], list(names))
    assert [r.dominant_class for r in dominant_class(df).collect()] == ["Human", "Stealth AI", "Default", "Monitoring"]


@pytest.mark.parametrize(
    "text, report, score",
    [
        ("Show all IPs", "unique-ips", 2),
        ("unique IP addresses", "unique-ips", 2 * 2 + 3),
        ("isp", "residential-patterns", 2),  # listed before the other report with this keyword
        ("network provider", "subnet-clusters", 2),
        ("which country and city", "geographic-clusters", 4),
        ("hello", None, 0),
    ],
)
def test_routing(spark, text, report, score):
    row = route_text(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.report, row.score) == (report, score)


def test_explore_runs_the_named_report(web):
    assert "countries" in explorer.explore(web, "subnet please", AS_OF, rng="30d").columns
    assert explorer.explore(web, "hello", AS_OF) is None


def test_bot_flag_only_moves_when_asked(web):
    for run in (lambda **k: training_agents(web, **k), lambda **k: human_patterns(web, AS_OF, **k)):
        assert "is_bot" not in run().columns and "is_bot" in run(fix_is_bot=True).columns
    assert as_monitoring(web).columns == ["id", "old_class", "new_class", "bot_classification"]


def test_uncapped_monitoring_covers_the_capped(web):
    some = as_monitoring(web, cap=3).select("id")
    assert some.exceptAll(as_monitoring(web, cap=None).select("id")).count() == 0


def test_views(spark, web):
    summaries.register_views(web)
    assert spark.sql("select sum(requests) from daily_stats").first()[0] == web.count()
    assert spark.sql("select count(*) from bot_summary").first()[0] > 0


def test_patterns_respect_the_declared_checks(web):
    patterns = journeys.behavior_patterns(web)
    assert patterns.where("confidence_score < 0 or confidence_score > 1").count() == 0
    assert journeys.journeys(web).where("funnel_stage not between 1 and 3").count() == 0


def test_reports_do_not_depend_on_partitions(web):
    for report in (explorer.unique_ips, explorer.subnet_clusters, explorer.datacenter_ips):
        a = report(web.repartition(13, "path"), AS_OF, "30d").collect()
        assert a == report(web.coalesce(1), AS_OF, "30d").collect()


def test_hot_address_gives_the_same_labels(spark, web):
    """A third of all rows on one address changes nothing but that address."""
    hot = web.withColumn("client_ip", F.when(F.col("id") % 3 == 0, "10.9.9.9").otherwise(F.col("client_ip")))
    plain = sorted(map(tuple, human_patterns(hot, AS_OF).collect()), key=str)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        salted = sorted(map(tuple, human_patterns(hot, AS_OF).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert plain == salted


def test_backfill_skips_loaded_days(spark, tmp_path):
    from tests.test_sources import line

    geo = networks(
        spark.createDataFrame(
            [("10.0.0.0/8", "AA", "T", 1.0, 1.0)],
            "network string, country string, city string, latitude double, longitude double",
        )
    )
    asn = networks(spark.createDataFrame([("10.0.0.0/8", 1, "Org")], "network string, asn int, asn_org string"))
    logs_dir = tmp_path / "logs"
    logs_dir.mkdir()
    day = 86400
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    lines = [line(ts=start + i * day, headers={"Cf-Ipcountry": ["DE"]}) for i in range(3)] + [line(ts=start, host="x.example")]
    (logs_dir / "a.log").write_text("\n".join(lines))
    path = str(tmp_path / "events")
    backfill.backfill(spark, str(logs_dir), "2024-01-01", "2024-01-02", geo, asn, path)
    table = spark.read.parquet(path)
    assert table.count() == 2
    backfill.backfill(spark, str(logs_dir), "2024-01-01", "2024-01-03", geo, asn, path, existing=table)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 3 and len({r.event_date for r in rows}) == 3
    assert {(r.country, r.city, r.asn, r.path, r.query_string) for r in rows} == {("DE", "T", 1, "/a?b=1", None)}


def _scans(df, name="events.parquet"):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(f"sf0.001/{name}")


def test_reports_read_the_events_once(spark):
    from visitlens.plans import investigate

    fresh = web_events(spark, SF)
    assert _scans(dashboard.filled_timeline(fresh, AS_OF, "7d")) == 1
    # These read a staged aggregate that one pass over the events has written.
    assert [_scans(f) for f in dashboard.dashboard(fresh, AS_OF, "7d").values()] == [0, 0, 0, 0]
    assert _scans(investigate.ip_profile(fresh, None)) == _scans(journeys.journeys(fresh)) == 0
    assert _scans(journeys.behavior_patterns(fresh)) == 0


def test_limits_may_be_none(web):
    from visitlens.plans import investigate

    some = explorer.unique_ips(web, AS_OF, "30d", limit=3)
    every = explorer.unique_ips(web, AS_OF, "30d", limit=None)
    assert some.count() == 3 < every.count()
    assert explorer.subnet_clusters(web, AS_OF, "30d", limit=None).count() >= explorer.subnet_clusters(web, AS_OF, "30d").count()
    sites = investigate.hosting_humans(web, sample=None).collect()
    assert all(len(r.sample_ips) == r.unique_ips for r in sites)


def test_unknown_commands_get_suggestions(web):
    assert explorer.explore(web, "xyzzy", AS_OF) is None
    assert all(explorer.explore(web, s, AS_OF) is not None for s in explorer.suggestions())


def test_row_jobs_in_place_equal_their_change_sets(web):
    from visitlens.operators import changes, reclassify

    for job in ("full_rerun", "undetermined_rerun", "as_monitoring", "hosting_networks"):
        change_set = getattr(reclassify, job)(web)
        columns = [c for c, kind in web.dtypes if not kind.startswith("map")]
        a, b = changes.apply_changes(web, change_set).select(columns), reclassify.applied(web, job).select(columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_visitor_checks_counted_in_one_read(spark):
    """Visitors of each check, of several and of none; nulls in every key; rows on the edges of both ranges."""
    import random

    from visitlens.plans import investigate

    rng = random.Random(5)
    end = dt.datetime(2024, 1, 31)
    rows = [(None, None, "/", 3), ("edge", "a", "/1", 7 * 86400), ("edge", "a", "/1", 30 * 86400), ("edge", "a", None, 0)]
    rows += [("fast", "a", "/same", 1000 + i) for i in range(120)]
    rows += [("paths", "a", f"/{i % 60}", i * 300) for i in range(600)]
    rows += [(None, "awake", f"/{i % 3}", i * 1800) for i in range(300)]
    rows += [("awake", f"agent{i % 3}", f"/{i % 4}", i * 1800) for i in range(300)]
    rows += [("old", "a", "/x", 8 * 86400 + i * 1800) for i in range(300)]
    rows += [(rng.choice("pqr"), rng.choice(["a", None]), rng.choice(["/a", "/b", None]), rng.randrange(31 * 86400)) for _ in range(400)]
    events = spark.createDataFrame(
        [(i, ip, agent, path, end - dt.timedelta(seconds=s), "human", None, None, None, None, None) for i, (ip, agent, path, s) in enumerate(rows)],
        "id int, client_ip string, user_agent string, path string, timestamp timestamp, bot_classification string, "
        "datacenter_provider string, has_sec_fetch_headers boolean, has_client_hints boolean, asn_org string, country string",
    )
    as_of = "2024-01-31 00:00:00"
    listed = [f(events, as_of, None).count() for f in (investigate.too_fast_humans, investigate.path_traversal, investigate.sleepless_humans)]
    assert all(listed)
    counted = investigate.suspicious_visitors(events, as_of)
    assert counted.first()[0] == sum(listed)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Sort [" not in plan

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from visitlens.functions.requests import client_ip_expr, event_key
from visitlens.operators import changes as C
from visitlens.operators import filters as P
from visitlens.schema import PROGRESS, STORED_EVENT, WEB_EVENT
from visitlens.sources import dims, logs, sinks


def line(ts=1704103200.1239, logger="http.log.access.log0", headers=None, **over):
    request = {
        "client_ip": "10.0.0.9",
        "remote_ip": "10.0.0.8",
        "host": "guide.example.org",
        "method": "GET",
        "uri": "/a?b=1",
        "headers": {"User-Agent": ["x"], **(headers or {})},
    }
    record = {"logger": logger, "ts": ts, "duration": 0.5, "status": 200, "size": 7, "request": {**request, **over}}
    return json.dumps(record)


LINES = [
    line(),
    "{not json http.log.access",
    line(logger="http.handlers.file"),
    line(client_ip=None, remote_ip=None),
    line(ts=None),
    line(ts=1704189600.0, uri="/a?b=1?c=2", headers={"Cf-Connecting-Ip": ["1.1.1.1"], "X-Forwarded-For": ["2.2.2.2"]}),
    line(ts=1704189601.0, uri="?q", headers={"X-Forwarded-For": ["2.2.2.2"], "Cf-Connecting-Ip": [""]}),
    line(ts=1704276000.0, uri=None, host=None, method=None),
]


@pytest.fixture
def log_dir(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LINES) + "\n")
    return str(folder)


def test_scan_splits_good_from_bad(spark, log_dir):
    good, bad = logs.read_logs(spark, log_dir)
    assert good.count() == 4
    assert {r.line for r in bad.collect()} == {LINES[1], LINES[3], LINES[4]}


def test_scan_from_a_mark_includes_it(spark, log_dir):
    good, _ = logs.read_logs(spark, log_dir, since="2024-01-02 10:00:00")
    assert good.count() == 3
    good, _ = logs.read_logs(spark, log_dir, since="2024-01-02 10:00:00.001")
    assert good.count() == 2


def test_parsed_columns(spark, log_dir):
    good, _ = logs.read_logs(spark, log_dir)
    rows = sorted(logs.parse_logs(good).collect(), key=lambda r: r.timestamp)
    first, second, third, last = rows
    assert first.timestamp == dt.datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert (first.client_ip, first.path, first.query_string, first.user_agent) == ("10.0.0.9", "/a", "b=1", "x")
    assert (second.client_ip, second.path, second.query_string) == ("1.1.1.1", "/a", "b=1")
    assert (third.client_ip, third.path, third.query_string) == ("2.2.2.2", "/", "q")
    assert (last.path, last.query_string, last.site, last.method) == ("/", None, "unknown", "GET")


def test_missing_numbers_default_to_zero(spark):
    text = json.dumps({"logger": "http.log.access", "ts": 1.0, "request": {"client_ip": "10.0.0.1"}})
    good, _ = logs.split_lines(spark.createDataFrame([(text,)], "value string"))
    row = logs.parse_logs(good).first()
    assert (row.duration, row.status, row.response_size, row.user_agent) == (0.0, 0, 0, None)


def test_historical_scan_takes_whole_days(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        folder = tmp_path / f"event_date={day}"
        folder.mkdir()
        start = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp()
        (folder / "a.log").write_text("\n".join([line(ts=start), line(ts=start + 86399.9995)]))
    df = logs.read_logs_range(spark, str(tmp_path), "2024-01-01", "2024-01-02")
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    row = logs.parse_logs(df, "backfill").first()
    assert row.path == "/a?b=1" and row.client_ip == "10.0.0.8"


def test_proxy_chain(spark):
    def address(headers, remote="9.9.9.9"):
        df = spark.createDataFrame(
            [((headers, remote),)], "request struct<headers: map<string,array<string>>, remote_ip: string>"
        )
        return df.select(client_ip_expr("proxy")).first()[0]

    assert address({"cf-connecting-ip": ["1.1.1.1"], "x-forwarded-for": ["2.2.2.2"]}) == "1.1.1.1"
    assert address({"x-forwarded-for": [" 2.2.2.2 , 3.3.3.3"]}) == "2.2.2.2"
    assert address({"x-forwarded-for": [""], "x-real-ip": ["4.4.4.4"]}) == "4.4.4.4"
    assert address({}) == "9.9.9.9"
    with pytest.raises(ValueError):
        client_ip_expr("other")


@pytest.mark.parametrize("text, want", [("", []), ("[]", []), ('[{"value":"a"},{"value":"a"},{"value":""},{},{"value":"b"}]', ["a", "b"])])
def test_bans(spark, tmp_path, text, want):
    path = tmp_path / "bans.json"
    path.write_text(text)
    assert sorted(r[0] for r in dims.read_bans(spark, str(path)).collect()) == want


def test_range_files(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("network,country,city,latitude,longitude\n10.0.0.0/8,AA,Town,1.5,2.5\nbad,BB,,0,0\n")
    rows = dims.read_geo_ranges(spark, str(path)).collect()
    assert [(r.family, r.bits, r.prefix, r.country) for r in rows] == [(4, 8, "0a", "AA")]
    spark.createDataFrame([("10.0.0.0/8", 1, "Org")], "network string, asn int, asn_org string").write.parquet(str(tmp_path / "asn"))
    assert dims.read_asn_ranges(spark, str(tmp_path / "asn")).first().asn_org == "Org"


def test_last_mark(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, None, 1, 1, t), (t + dt.timedelta(days=1), None, 1, 1, t - dt.timedelta(days=1))]
    assert dims.last_mark(spark.createDataFrame(rows, PROGRESS)).first()[0] == t
    assert dims.last_mark(spark.createDataFrame([], PROGRESS)).first()[0] is None


def events(spark, n=6):
    return spark.range(n).selectExpr(
        "id", "timestamp_seconds(1704067200 + id * 43200) as timestamp", "0.25D as duration", "concat('10.0.0.', id) as client_ip",
        "'s' as site", "'GET' as method", "'/p' as path", "200 as status", "concat('r', id) as cf_ray",
        "'bot_undetermined' as bot_classification", "'old' as bot_name", "true as is_bot", "3 as detection_level",
    )


def test_stored_layout(spark, tmp_path):
    assert len(WEB_EVENT.fields) == 35
    path = str(tmp_path / "events")
    sinks.append_events(events(spark), path)
    sinks.append_events(events(spark).withColumn("id", F.col("id") + 100), path)
    table = spark.read.parquet(path)
    assert table.count() == 12 and table.select("event_date").distinct().count() == 3
    assert set(table.columns) == {f.name for f in STORED_EVENT.fields} | {"batch_id"}
    sinks.append_events(events(spark), path, load_id=-5)
    sinks.append_events(events(spark), path, load_id=-5)
    assert spark.read.parquet(path).count() == 18 and sinks.read_events(spark, path).count() == 18
    with pytest.raises(ValueError):
        sinks.append_events(events(spark), path, load_id=0)
    assert sinks.read_days(spark, path, ["1999-01-01"]) is None
    assert sinks.read_days(spark, path, ["2024-01-02", "1999-01-01"]).count() == 6
    row = table.first()
    assert row.has_cf_worker is False and row.asn is None
    recent = P.since(table, 24, "2024-01-03 12:00:00")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThan(timestamp" in plan


def test_keys_are_stable(spark):
    df = events(spark).drop("id").withColumn("query_string", F.lit(None).cast("string"))
    ids = [[r.id for r in sinks.to_stored(df).orderBy("cf_ray").collect()] for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 6


def test_progress_row(spark):
    row = sinks.batch_metrics(events(spark), F.current_timestamp()).first()
    assert (row.last_cf_ray, row.records_processed) == ("r5", 6)
    assert row.last_processed_timestamp == dt.datetime(2024, 1, 3, 12) and row.ingestion_duration_ms >= 0


def change_set(spark):
    return spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), "human", None, None), (4, dt.date(2024, 1, 3), "human", None, None)],
        "id long, event_date date, bot_classification string, bot_name string, detection_level int",
    )


def test_changes_write_nulls_too(spark):
    after = {r.id: r for r in C.apply_changes(events(spark), change_set(spark).drop("event_date")).collect()}
    assert len(after) == 6
    assert (after[1].bot_classification, after[1].bot_name, after[1].detection_level) == ("human", None, None)
    assert (after[2].bot_classification, after[2].bot_name, after[2].is_bot) == ("bot_undetermined", "old", True)


def test_copies_of_an_event_are_not_multiplied(spark):
    twice = sinks.to_stored(events(spark).unionAll(events(spark)))
    changes = twice.select("id", "event_date", "timestamp", F.lit("human").alias("bot_classification"))
    after = C.apply_changes(twice, changes)
    assert after.count() == 12 and after.where("bot_classification = 'human'").count() == 12


def test_compacted_append(spark, tmp_path):
    sinks.append_events(events(spark, 50), str(tmp_path / "e"), compact=True)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 50


def test_only_touched_days_are_rewritten(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "patched")
    sinks.append_events(events(spark), path)
    run = C.rewrite_partitions(spark, path, change_set(spark), out)
    patched = spark.read.parquet(f"{run}/events")
    assert {str(r.event_date) for r in patched.select("event_date").distinct().collect()} == {"2024-01-01", "2024-01-03"}
    assert patched.count() == 4 and patched.where("bot_classification = 'human'").count() == 2
    assert sinks.read_events(spark, path).where("bot_classification = 'human'").count() == 0
    for _ in range(2):
        assert C.commit_partitions(spark, run, path) == []
    after = sinks.read_events(spark, path)
    assert after.count() == 6 and after.where("bot_classification = 'human'").count() == 2


def test_key_tells_requests_apart(spark):
    base = dict(cf_ray=None, timestamp=dt.datetime(2024, 1, 1), client_ip="10.0.0.1", site="s", path="/", query_string=None, method="GET")
    base |= dict(status=200, response_size=5, duration=0.5, user_agent="a", referer=None, accept_language=None)
    others = [{}, {"status": 404}, {"user_agent": "b"}, {"response_size": 6}, {"duration": 0.6}, {"referer": "a", "user_agent": None}]
    others += [{"referer": None, "user_agent": None}, {"accept_language": "a", "user_agent": None}]
    schema = "cf_ray string, timestamp timestamp, client_ip string, site string, path string, query_string string, method string, "
    schema += "status int, response_size long, duration double, user_agent string, referer string, accept_language string"
    df = spark.createDataFrame([tuple((base | o).values()) for o in others], schema)
    assert df.select(event_key(df.columns)).distinct().count() == len(others)


@pytest.mark.parametrize("ts", [1.7e12, 1.7e15, 1e17, -1.0, 253402300800.0])
def test_odd_times_are_bad_lines(spark, ts):
    lines = [json.dumps({"logger": "http.log.access", "ts": t, "request": {"client_ip": "10.0.0.1"}}) for t in (ts, 1.7e9, 0.0)]
    good, bad = logs.split_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 2 and [r.line for r in bad.collect()] == lines[:1]
    assert logs.parse_logs(good).count() == 2


def test_csv_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", you', ["a", "b"], None), (2, None, [], 1.5)], "asn int, asn_org string, countries array<string>, avg_lat double"
    )
    path = str(tmp_path / "out")
    sinks.export_csv(df.coalesce(1), path)
    parts = sorted(f for f in (tmp_path / "out").iterdir() if f.suffix == ".txt")
    text = "".join(f.read_text() for f in parts).splitlines()
    assert text[0] == '"Asn","Asn Org","Countries","Avg Lat"'
    assert text[1:] == ['"1","say ""hi"", you","a; b",', '"2",,"","1.5"']


def test_display_sort(spark):
    df = spark.createDataFrame([(1, "b"), (3, "a"), (2, "c")], "n int, t string")
    assert [r.n for r in sinks.sort_for_display(df, "n").collect()] == [3, 2, 1]
    assert [r.t for r in sinks.sort_for_display(df, "t").collect()] == ["a", "b", "c"]


def test_range_is_strict_and_unknown_means_a_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0),), (dt.datetime(2024, 1, 1, 0, 0, 0, 1),)], "timestamp timestamp")
    for rng in ("24h", "nonsense"):
        assert P.in_range(df, rng, "2024-01-02 00:00:00").count() == 1


def test_topic_filter_spares_the_www_host(spark):
    rows = [("booking.example.com", "/x"), ("www.booking.example.com", "/x"), ("booking.example.com", "/MEMORY")]
    df = spark.createDataFrame(rows, "site string, path string")
    assert P.topic_only(df).count() == 2


def test_loaded_days_are_skipped(spark):
    stored = sinks.to_stored(events(spark))
    loaded = stored.where("id = 2")
    assert {r.id for r in P.skip_loaded_days(stored, loaded).collect()} == {0, 1, 4, 5}
    assert P.expire(stored, "2024-01-04", 2).count() == 2

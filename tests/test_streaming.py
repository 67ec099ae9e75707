import datetime as dt
import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from visitlens.operators.ranges import networks
from visitlens.sources import logs
from visitlens.streaming import ingest as G
from visitlens.streaming.scratch import shared_dir

BASE = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp()


def line(i, ip="10.0.0.1", uri="/a", host="guide.example.org", at=None):
    request = {"client_ip": ip, "host": host, "method": "GET", "uri": uri, "headers": {"User-Agent": ["curl/8"], "Cf-Ray": [f"r{i}"]}}
    return json.dumps({"logger": "http.log.access.log0", "ts": BASE + (i if at is None else at), "status": 200, "request": request})


@pytest.fixture
def job(spark, tmp_path):
    geo = networks(
        spark.createDataFrame(
            [("10.0.0.0/8", "AA", "Town", 1.0, 2.0)],
            "network string, country string, city string, latitude double, longitude double",
        )
    )
    asn = networks(spark.createDataFrame([("10.0.0.0/24", 8075, "Big")], "network string, asn int, asn_org string"))
    root = shared_dir(spark, "job")
    (tmp_path / "logs").mkdir()
    (tmp_path / "bans.json").write_text('[{"value": "10.0.0.66"}]')
    return G.Ingestion(f"{root}/events", f"{root}/progress", f"{root}/state", geo, asn, bans_path=str(tmp_path / "bans.json"))


def run(spark, tmp_path, job):
    query = G.ingest_stream(spark, str(tmp_path / "logs"), job)
    query.awaitTermination()
    return spark.read.parquet(job.events_path)


def put(tmp_path, name, lines):
    (tmp_path / "logs" / name).write_text("\n".join(lines) + "\n")


def test_batches_add_up_and_repeats_do_not(spark, tmp_path, job):
    put(tmp_path, "1.log", [line(1), line(2), line(3, ip="10.0.0.66"), line(4, ip="184.82.29.117"), "http.log.access oops"])
    first = run(spark, tmp_path, job)
    assert {r.cf_ray for r in first.collect()} == {"r1", "r2"}
    put(tmp_path, "2.log", [line(2), line(5), line(6, uri="/.env"), line(7, host="old.example.net")])
    (tmp_path / "bans.json").write_text("[]")
    put(tmp_path, "3.log", [line(8, ip="10.0.0.66")])
    rows = {r.cf_ray: r for r in run(spark, tmp_path, job).collect()}
    assert set(rows) == {"r1", "r2", "r5", "r8"}
    r = rows["r1"]
    assert (r.country, r.asn, r.datacenter_provider, r.subnet) == ("AA", 8075, "azure", "10.0.0.0/24")
    assert (r.bot_classification, r.bot_name, r.is_bot) == ("web_crawler", "Generic-Crawler", True)
    progress = spark.read.parquet(job.progress_path).orderBy("batch_id").collect()
    assert [p.records_processed for p in progress] == [2, 2]
    assert progress[-1].last_cf_ray == "r8"
    run(spark, tmp_path, job)
    assert spark.read.parquet(job.events_path).count() == 4


def test_replayed_batch_replaces_itself(spark, tmp_path, job):
    good, _ = logs.split_lines(spark.createDataFrame([(line(i),) for i in range(5)], "value string"))
    batch = logs.parse_logs(good)
    batch = batch.withColumn("id", G.event_key(batch.columns))
    G.write_batch(batch, 0, job)
    G.write_batch(batch, 0, job)
    G.write_batch(batch.limit(2).withColumn("id", F.col("id") + 1), 1, job)
    G.write_batch(batch, 2, job)
    assert spark.read.parquet(job.events_path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 5), (1, 2)]


def test_batch_without_wanted_rows_moves_no_mark(spark, tmp_path, job):
    put(tmp_path, "1.log", [line(1)])
    run(spark, tmp_path, job)
    put(tmp_path, "2.log", [line(2, ip="10.0.0.66")])
    run(spark, tmp_path, job)
    assert spark.read.parquet(job.progress_path).count() == 1


def test_stream_equals_batch(spark, tmp_path, job):
    lines = [line(i, ip=f"10.0.0.{i % 7}", uri=f"/p{i % 3}") for i in range(40)]
    for part in range(4):
        put(tmp_path, f"{part}.log", lines[part::4])
    streamed = run(spark, tmp_path, job).drop("batch_id", "headers_json")
    good, _ = logs.split_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    built = G.build_events(G.wanted(logs.parse_logs(good)), job.geo, job.networks)
    batch = G.to_stored(built).drop("headers_json").select(*streamed.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_bad_lines_are_kept(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    put(tmp_path, "1.log", [line(1), "http.log.access oops"])
    root = shared_dir(spark, "bad")
    G.bad_lines_stream(spark, str(tmp_path / "logs"), f"{root}/out", f"{root}/state").awaitTermination()
    assert [r.value for r in spark.read.text(f"{root}/out").collect()] == ["http.log.access oops"]


def test_rows_before_the_mark_are_left_out(spark, tmp_path, job):
    put(tmp_path, "1.log", [line(1), line(2), line(3)])
    from dataclasses import replace

    late = replace(job, since="2024-01-01 12:00:02")
    assert {r.cf_ray for r in run(spark, tmp_path, late).collect()} == {"r2", "r3"}


def test_starting_mark(spark):
    now = dt.datetime(2024, 1, 2)
    assert G.starting_mark(None, now) == dt.datetime(2024, 1, 1, 23)
    rows = [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))]
    progress = spark.createDataFrame(rows, "last_processed_timestamp timestamp, created_at timestamp")
    assert G.starting_mark(progress, now) == dt.datetime(2024, 1, 1)
    assert G.starting_mark(progress.limit(0), now) == dt.datetime(2024, 1, 1, 23)


def _stream(spark, tmp_path, rows):
    path = str(tmp_path / "src")
    spark.createDataFrame(rows, "timestamp timestamp, client_ip string, site string").write.parquet(path)
    return spark.readStream.schema("timestamp timestamp, client_ip string, site string").parquet(path)


def _drain(spark, df):
    root = shared_dir(spark, "drain")
    writer = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@pytest.mark.parametrize("size", ["5 minutes", "1 hour", "2 hours", "1 day"])
def test_window_sizes(spark, tmp_path, size):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), f"10.0.0.{m % 3}", "www.guide.example.org") for m in range(0, 3000, 7)]
    out = _drain(spark, G.timeline_stream(_stream(spark, tmp_path, rows), size)).collect()
    width = {"5 minutes": 300, "1 hour": 3600, "2 hours": 7200, "1 day": 86400}[size]
    assert out and all(r.site == "guide.example.org" for r in out)
    assert all(r.time_bucket.replace(tzinfo=dt.timezone.utc).timestamp() % width == 0 for r in out)


def test_sessions_close_after_the_gap(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    minutes = [0, 10, 20, 100, 110, 1000]
    out = _drain(spark, G.sessions_stream(_stream(spark, tmp_path, [(t + dt.timedelta(minutes=m), "10.0.0.1", "s") for m in minutes])))
    got = sorted((r.request_count, r.span_seconds) for r in out.collect())
    assert got == [(2, 600.0), (3, 1200.0)]


def test_scratch_folder_comes_from_the_configuration(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Unset:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "hdfs:///warehouse/"}.get(name, default)

    assert shared_dir(Unset, "x").startswith("hdfs:///warehouse/x-")


def test_late_rows_are_stored(spark, tmp_path, job):
    from dataclasses import replace

    slow = replace(job, max_files=1)
    for part, at in enumerate((7200, 3600, -7200, -90_000)):
        put(tmp_path, f"{part}.log", [line(100 * part + i, at=at + i) for i in range(10)])
        run(spark, tmp_path, slow)
    assert spark.read.parquet(job.events_path).count() == 40
    put(tmp_path, "again.log", [line(i, at=7200 + i) for i in range(10)])
    assert run(spark, tmp_path, slow).count() == 40


def test_requests_without_a_ray_id_are_kept_apart(spark, tmp_path, job):
    def bare(status, agent):
        request = {"client_ip": "10.0.0.1", "host": "h", "uri": "/", "headers": {"User-Agent": [agent]}}
        return json.dumps({"logger": "http.log.access", "ts": BASE, "status": status, "request": request})

    put(tmp_path, "1.log", [bare(200, "a"), bare(404, "a"), bare(200, "b"), bare(200, "a")])
    assert run(spark, tmp_path, job).count() == 3


def test_bad_lines_of_ingestion_are_set_aside(spark, tmp_path, job):
    from dataclasses import replace

    put(tmp_path, "1.log", [line(1), "http.log.access oops"])
    run(spark, tmp_path, replace(job, bad_path=f"{job.events_path}-bad"))
    assert [r.value for r in spark.read.text(f"{job.events_path}-bad").collect()] == ["http.log.access oops"]


def test_ingestion_takes_up_at_the_mark(spark, tmp_path, job):
    from dataclasses import replace

    marked = replace(job, since="mark")
    now = dt.datetime.now()
    assert abs(G.beginning(spark, marked) - (now - dt.timedelta(hours=1))) < dt.timedelta(minutes=1)
    put(tmp_path, "1.log", [line(1), line(2)])
    run(spark, tmp_path, job)
    assert G.beginning(spark, marked) == dt.datetime(2024, 1, 1, 12, 0, 2)


def test_open_windows_complete_the_result(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), f"10.0.0.{m % 3}", "guide.example.org") for m in range(0, 300, 7)]
    stream = _stream(spark, tmp_path, rows)
    out = _drain(spark, G.timeline_stream(stream, "1 hour"))
    batch = G.timeline_stream(spark.read.parquet(str(tmp_path / "src")), "1 hour")
    whole = G.with_open(out, batch, ["time_bucket", "site"])
    assert 0 < out.count() < 5 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, batch.collect()))
    assert all(r["count"] == 3 for r in out.collect())


@pytest.mark.parametrize("more", [(), ("times_path",), ("kept_path",), ("activity_path",)])
def test_a_batch_takes_no_memory_for_its_rows(spark, tmp_path, job, monkeypatch, more):
    """Rows that are read more than once are staged, not cached, and the staged ones are gone at the end."""
    cached, staged = [], set()

    def write(stored, path, real=G.write_events):
        cached.extend(spark.sparkContext._jsc.sc().getRDDStorageInfo())
        staged.update(p.name.partition("-")[0] for p in scratch(spark) if p.name.startswith(("lines-", "fresh-")))
        real(stored, path)

    monkeypatch.setattr(G, "write_events", write)
    before = scratch(spark)
    job = replace(job, bad_path=f"{tmp_path}/bad", **{name: f"{tmp_path}/{name}" for name in more})
    put(tmp_path, "1.log", [line(1), line(2), line(2), "http.log.access oops"])
    assert {r.cf_ray for r in run(spark, tmp_path, job).collect()} == {"r1", "r2"}
    assert [r.value for r in spark.read.text(job.bad_path).collect()] == ["http.log.access oops"]
    assert (cached, staged) == ([], {"lines", "fresh"})
    assert not [p for p in scratch(spark) - before if p.name.startswith(("lines-", "fresh-"))]


def scratch(spark):
    return set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())

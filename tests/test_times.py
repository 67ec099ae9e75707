import dataclasses

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import BASE, job, line, put, run  # noqa: F401
from visitlens.sources import sinks, upkeep
from visitlens.streaming import times
from visitlens.streaming.scratch import shared_dir

DAY = 86_400


@pytest.fixture
def sparing(spark, job):  # noqa: F811
    return dataclasses.replace(job, times_path=f"{shared_dir(spark, 'sparing')}/times", max_files=1)


def batch_of(spark, seconds):
    at = BASE
    return spark.createDataFrame([(at + s,) for s in seconds], "at double").select(F.timestamp_seconds("at").alias("timestamp"))


def test_only_directories_with_a_second_in_common_are_read(spark, tmp_path, sparing):
    put(tmp_path, "1.log", [line(1), line(2), line(20_000)])
    run(spark, tmp_path, sparing)
    put(tmp_path, "2.log", [line(3, at=600), line(4, at=DAY + 600)])
    run(spark, tmp_path, sparing)
    put(tmp_path, "3.log", [line(5, at=2), line(2), line(6, at=601)])  # one anew, one repeated, one late
    run(spark, tmp_path, sparing)
    stored = sinks.read_events(spark, sparing.events_path)
    assert sorted(r.cf_ray for r in stored.collect()) == ["r1", "r2", "r20000", "r3", "r4", "r5", "r6"]
    first, second = sorted(r[0] for r in stored.select("event_date").distinct().collect())

    def found(*seconds):
        return times.may_hold(batch_of(spark, seconds), sparing.events_path, sparing.times_path, [first, second])

    assert found(1) == [(first, 0)] and found(2) == [(first, 0), (first, 2)]
    assert found(600, 601) == [(first, 1), (first, 2)] and found(DAY + 600) == [(second, 1)]
    assert found(20_000) == [(first, 0)] and found(5, DAY + 1) == [] and found() == []
    batch = batch_of(spark, [600])
    read = times.read_candidates(batch, sparing.events_path, sparing.times_path, [first])
    assert {f.split("batch_id=")[1].split("/")[0] for f in read.inputFiles()} == {"1"}
    assert times.read_candidates(batch_of(spark, [7]), sparing.events_path, sparing.times_path, [first]) is None


def test_loads_and_merged_days_are_always_read(spark, tmp_path, sparing):
    put(tmp_path, "1.log", [line(1)])
    run(spark, tmp_path, sparing)
    put(tmp_path, "2.log", [line(2, at=50)])
    run(spark, tmp_path, sparing)
    path = sparing.events_path
    day = upkeep.stored_days(spark, path)[0]
    sinks.append_events(sinks.read_events(spark, path).where("cf_ray = 'r1'").withColumn("cf_ray", F.lit("load")), path, load_id=-3)
    assert times.may_hold(batch_of(spark, [50]), path, sparing.times_path, [day]) == [(day, -3), (day, 1)]
    upkeep.compact(spark, path, shared_dir(spark, "runs"), [day])
    assert times.may_hold(batch_of(spark, [9]), path, sparing.times_path, [day]) == [(day, upkeep.COMPACTED), (day, -3)]
    put(tmp_path, "3.log", [line(1), line(2, at=50), line(3, at=50)])
    run(spark, tmp_path, sparing)
    assert sinks.read_events(spark, path).count() == 4

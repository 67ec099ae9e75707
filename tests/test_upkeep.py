import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests import test_sources
from visitlens.operators import changes as C
from visitlens.sources import sinks, upkeep

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3)]


def events(spark, n):
    """Events of three days."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3 * 86400 + F.col("id"))
    return test_sources.events(spark, n).withColumn("timestamp", at)


def labels(spark, path):
    return {r.id: r.bot_classification for r in sinks.read_events(spark, path).collect()}


def change(spark, path, label, where):
    return sinks.read_events(spark, path).where(where).select(*C.ROW_KEYS, F.lit(label).alias("bot_classification"))


def directories(path, day):
    return sorted(n for n in os.listdir(f"{path}/event_date={day}") if n.startswith("batch_id="))


def batch(df, path, number):
    """What a batch of the stream stores."""
    sinks.write_events(sinks.to_stored(df).withColumn("batch_id", F.lit(number).cast("long")), path)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "events")
    for n in (-1, -2):
        sinks.append_events(events(spark, 30).where(f"id % 2 = {n + 2}"), path, load_id=n)
    return path, str(tmp_path / "runs")


def test_runs_that_share_a_folder_keep_the_newest_labels(spark, table):
    path, out = table
    before = labels(spark, path)
    C.relabel(spark, path, change(spark, path, "first", "event_date = '2024-01-01'"), out)
    C.relabel(spark, path, change(spark, path, "second", "event_date = '2024-01-01'"), out)
    C.relabel(spark, path, change(spark, path, "third", "event_date = '2024-01-02'"), out)
    day = {r.id: str(r.event_date) for r in sinks.read_events(spark, path).collect()}
    want = {"2024-01-01": "second", "2024-01-02": "third"}
    assert labels(spark, path) == {i: want.get(day[i], c) for i, c in before.items()}


def test_a_load_that_was_replaced_meanwhile_is_not_put_back(spark, table, monkeypatch):
    path, out = table
    run = C.rewrite_partitions(spark, path, change(spark, path, "stale", "true"), out)
    sinks.append_events(events(spark, 30).where("id % 2 = 1 and id % 5 != 0"), path, load_id=-1)
    refused = C.commit_partitions(spark, run, path)
    assert refused and {b for _, b in refused} == {-1}
    now = labels(spark, path)
    assert {i for i, c in now.items() if c == "stale"} == {i for i in now if i % 2 == 0}
    assert sorted(i for i in now if i % 2) == [i for i in range(30) if i % 2 and i % 5]
    with pytest.raises(upkeep.Conflict):
        # The change set is made anew from the table, and a load comes between the two halves of the run.
        changes = change(spark, path, "late", "true").cache()
        changes.count()
        monkeypatch.setattr(C, "commit", lambda *a: (sinks.append_events(events(spark, 30).where("id % 2 = 1"), path, load_id=-1), upkeep.commit(*a))[1])
        C.relabel(spark, path, changes, out)


def test_a_commit_that_broke_off_is_run_again(spark, table, monkeypatch):
    path, out = table
    run = C.rewrite_partitions(spark, path, change(spark, path, "new", "true"), out)
    # It breaks off after one of its days.
    some = sinks.read_events(spark, f"{run}/events").where("event_date = '2024-01-02'")
    sinks.write_events(some, path)
    for _ in range(2):
        assert C.commit_partitions(spark, run, path) == []
        assert set(labels(spark, path).values()) == {"new"}


def test_versions_change_with_files_only(spark, table):
    path, _ = table
    before = upkeep.versions(spark, path, DAYS).collect()
    assert before and sorted(before) == sorted(upkeep.versions(spark, path, DAYS).collect())
    sinks.append_events(events(spark, 30).where("id % 2 = 1"), path, load_id=-1)
    after = {(r.event_date, r.batch_id): r.version for r in upkeep.versions(spark, path, DAYS).collect()}
    assert all((after[r.event_date, r.batch_id] == r.version) == (r.batch_id == -2) for r in before)
    assert upkeep.versions(spark, path, [dt.date(2030, 1, 1)]).isEmpty()


@pytest.fixture
def batches(spark, tmp_path):
    path = str(tmp_path / "events")
    for n in range(4):
        batch(events(spark, 40).where(f"id % 4 = {n}"), path, n)
    sinks.append_events(events(spark, 50).where("id >= 41"), path, load_id=-7)
    return path, str(tmp_path / "runs")


def test_compaction_keeps_rows_and_loads(spark, batches):
    path, out = batches
    before = labels(spark, path)
    upkeep.compact(spark, path, out, DAYS)
    assert labels(spark, path) == before and sinks.read_events(spark, path).count() == len(before)
    loads = {d: [n for n in directories(path, d) if n == "batch_id=-7"] for d in DAYS}
    assert all(directories(path, d) == sorted([f"batch_id={upkeep.COMPACTED}", *loads[d]]) for d in DAYS)
    # More batches of the day, and another compaction; one more has nothing to do.
    batch(events(spark, 61).where("id > 50"), path, 9)
    for _ in range(2):
        run = upkeep.compact(spark, path, out, DAYS)
        assert sinks.read_events(spark, path).count() == len(before) + 10
        assert all(len(directories(path, d)) <= 2 for d in DAYS)
    assert not os.path.exists(f"{run}/events")


def test_a_busy_day_is_merged_by_many_tasks(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "events"), str(tmp_path / "runs")
    monkeypatch.setattr(upkeep, "MERGED_ROWS", 20, raising=False)
    # Nearly all rows are of one day.
    rows = events(spark, 600).where("id % 3 = 0 or id < 9")
    for n in range(2):
        batch(rows.where(f"id % 2 = {n}"), path, n)
    run = upkeep.merge_days(spark, path, out, DAYS)
    merged = sinks.read_events(spark, f"{run}/events")
    files = merged.groupBy("event_date", F.input_file_name().alias("file")).count().collect()
    assert sum(r["count"] for r in files) == rows.count() and max(r["count"] for r in files) <= 60
    assert {r.event_date for r in files} == set(DAYS) and len([r for r in files if r.event_date != DAYS[0]]) <= 4
    assert sorted(merged.select("id").collect()) == sorted(sinks.read_events(spark, path).select("id").collect())


@pytest.mark.parametrize("broke", ["before", "between", "halfway"])
def test_compaction_that_broke_off_is_run_again(spark, batches, broke):
    path, out = batches
    before = labels(spark, path)
    run = upkeep.merge_days(spark, path, out, DAYS)
    if broke != "before":
        sinks.write_events(sinks.read_events(spark, f"{run}/events"), path)
    if broke == "halfway":
        upkeep.remove_folder(spark, f"{path}/event_date=2024-01-01/batch_id=2")
    for _ in range(2):
        assert upkeep.commit_merged(spark, run, path) == []
        assert labels(spark, path) == before and sinks.read_events(spark, path).count() == len(before)
        assert all(len(directories(path, d)) <= 2 for d in DAYS)


def test_a_batch_written_again_keeps_its_day_from_compaction(spark, batches):
    path, out = batches
    run = upkeep.merge_days(spark, path, out, DAYS)
    batch(events(spark, 40).where("id % 4 = 2 and id % 3 = 1"), path, 2)
    before = labels(spark, path)
    assert upkeep.commit_merged(spark, run, path) == [(dt.date(2024, 1, 2), 2)]
    assert labels(spark, path) == before and sinks.read_events(spark, path).count() == len(before)
    assert len(directories(path, DAYS[1])) >= 4 and len(directories(path, DAYS[0])) <= 2


def test_expired_days_are_removed_and_running_loads_left(spark, table):
    path, _ = table
    os.makedirs(f"{path}/.spark-staging-x/_temporary/0/_temporary/attempt_1/event_date=2024-01-01/batch_id=-9")
    assert upkeep.loading_days(spark, path) == {DAYS[0]}
    assert upkeep.expire_days(spark, path, "2024-01-12 00:00:00", days=10) == [DAYS[1]]
    assert upkeep.stored_days(spark, path) == [DAYS[0], DAYS[2]]
    assert upkeep.loading_days(spark, path, dt.timedelta(0)) == set()
    os.rename(f"{path}/.spark-staging-x", f"{path}/_done")
    assert upkeep.expire_days(spark, path, "2024-01-12 00:00:00", days=10) == [DAYS[0]]
    assert upkeep.expire_days(spark, path, "2024-01-12 00:00:00", days=10) == []
    assert {str(r.event_date) for r in sinks.read_events(spark, path).select("event_date").distinct().collect()} == {"2024-01-03"}

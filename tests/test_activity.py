import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import BASE, job, put, run  # noqa: F401
from visitlens.operators.changes import ROW_KEYS, relabel
from visitlens.sources import sinks
from visitlens.streaming import activity, kept
from visitlens.streaming.scratch import shared_dir

CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
DAY = 86_400


def visit(i, ip, at):
    headers = {"User-Agent": [CHROME], "Sec-Fetch-Site": ["none"], "Sec-Fetch-Mode": ["navigate"], "Sec-Ch-Ua": ["x"], "Accept": ["text/html"]}
    request = {"client_ip": ip, "host": "guide.example.org", "method": "GET", "uri": f"/p{i}", "headers": headers}
    return json.dumps({"logger": "http.log.access.log0", "ts": BASE + at, "status": 200, "request": request})


def visits():
    """Requests of several paces: address -> seconds."""
    rng = random.Random(5)
    at = {"10.0.1.1": range(0, 40), "10.0.1.2": range(0, 4000, 100), "10.0.1.3": [7], "10.0.1.5": [DAY + x for x in range(9)]}
    at["10.0.1.4"] = [*range(0, 20), 900]  # fast until the last
    at["10.0.1.5"] += [3 * x for x in range(9)]  # slow on one day, fast on the next
    for n in range(6, 16):
        span = rng.choice([5, 30, 300])
        at[f"10.0.1.{n}"] = [rng.choice([0, DAY]) + rng.randrange(span) for _ in range(rng.randrange(1, 30))]
    return [(ip, s) for ip, some in at.items() for s in some]


def wanted(rows):
    """The label that the whole of an address's day gives."""
    by = {}
    for ip, s in rows:
        by.setdefault((ip, s // DAY), []).append(s)
    fast = {k: max(v) > min(v) and len(v) / (max(v) - min(v)) > 0.5 for k, v in by.items()}
    return {i: not fast[ip, s // DAY] for i, (ip, s) in enumerate(rows)}


def labels(spark, job):  # noqa: F811
    rows = sinks.read_events(spark, job.events_path).collect()
    found = {int(r.path[2:]): r.bot_classification == "human" for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def paced(spark, job):  # noqa: F811
    root = shared_dir(spark, "paced")
    return dataclasses.replace(job, activity_path=f"{root}/activity", kept_path=f"{root}/kept", max_files=1)


def test_ten_batches_in_any_order_give_the_labels_of_one(spark, tmp_path, paced):
    rows = visits()
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    for n in range(10):
        put(tmp_path, f"{n}.log", [visit(i, *rows[i]) for i in order[n::10]])
    put(tmp_path, "x.log", [visit(i, *rows[i]) for i in order[:25]])  # once more
    run(spark, tmp_path, paced)
    want = wanted(rows)
    assert set(want.values()) == {True, False}
    assert labels(spark, paced) == want
    got = kept.summed(kept.read_parts(spark, paced.kept_path), ["bot_classification"]).select("bot_classification", "requests")
    exact = sinks.read_events(spark, paced.events_path).groupBy("bot_classification").agg(F.count("*").alias("requests"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_a_repeated_amendment_changes_nothing_and_other_labels_stay(spark, tmp_path, paced):
    put(tmp_path, "1.log", [visit(0, "10.0.1.1", 0), visit(1, "10.0.1.1", 300), visit(2, "10.0.1.2", 0)])
    run(spark, tmp_path, paced)
    assert labels(spark, paced) == {0: True, 1: True, 2: True}
    events = sinks.read_events(spark, paced.events_path)
    mine = events.where("path = '/p1'").select(*ROW_KEYS, F.lit("mine").alias("bot_classification"))
    relabel(spark, paced.events_path, mine, shared_dir(spark, "mine"))
    put(tmp_path, "2.log", [visit(3 + i, "10.0.1.1", 1 + i) for i in range(200)])
    run(spark, tmp_path, paced)
    found = labels(spark, paced)
    assert not found[0] and not found[3] and found[2]
    stored = sinks.read_events(spark, paced.events_path)
    assert stored.where("path = '/p1'").first().bot_classification == "mine"
    days = [r[0] for r in stored.select("event_date").distinct().collect()]
    assert activity.amend(spark, paced.events_path, paced.activity_path, 1, days) == []


def test_activity_is_rebuilt_from_the_table(spark, tmp_path, paced):
    put(tmp_path, "1.log", [visit(i, ip, s) for i, (ip, s) in enumerate(visits())])
    run(spark, tmp_path, paced)
    days = [r[0] for r in sinks.read_events(spark, paced.events_path).select("event_date").distinct().collect()]
    before = sorted(map(tuple, activity.read_activity(spark, paced.activity_path, days).collect()))
    activity.rebuild(spark, paced.events_path, paced.activity_path, days)
    assert before and sorted(map(tuple, activity.read_activity(spark, paced.activity_path, days).collect())) == before
    assert activity.read_activity(spark, f"{paced.activity_path}-none", days).count() == 0

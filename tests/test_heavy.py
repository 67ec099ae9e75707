import random

import pytest
from pyspark.sql import functions as F

from visitlens.functions.metrics import requests
from visitlens.operators import heavy
from visitlens.operators.bursts import CHUNK, peaks
from visitlens.operators.heavy import heavy_groups
from visitlens.plans.common import top


def ranked(df, keys, limit, details=()):
    return [tuple(r) for r in top(df.groupBy(*keys).agg(requests("count"), *details), "count", keys, limit).collect()]


@pytest.fixture
def scanned(monkeypatch):
    """What was ranked: one entry if the summary's list was proven, two if all groups had to be."""
    calls = []
    monkeypatch.setattr(heavy, "top", lambda *a: calls.append(a) or top(*a))
    return calls


def zipf(spark, n=60_000):
    """Groups of which few stand out, many with one row, NULL among them."""
    return spark.range(n, numPartitions=7).selectExpr(
        "case when id % 3 = 0 then null when id % 7 < 3 then concat('a', id % 7) else concat('z', id) end as name",
        "id % 2 = 0 as even",
        "timestamp_seconds(id) as timestamp",
    )


def test_a_list_of_groups_that_stand_out_is_proven(spark, scanned):
    df = zipf(spark)
    got = heavy_groups(df, ["name", "even"], 6, [F.max("timestamp").alias("last")], tracked=300)
    assert [tuple(r) for r in got.collect()] == ranked(df, ["name", "even"], 6, [F.max("timestamp").alias("last")])
    assert len(scanned) == 1


def test_groups_of_one_size_are_all_ranked(spark, scanned):
    df = spark.range(20_000, numPartitions=5).selectExpr("pmod(hash(id), 4000) as k")
    assert [tuple(r) for r in heavy_groups(df, ["k"], 50, tracked=64).collect()] == ranked(df, ["k"], 50)
    assert len(scanned) == 2


@pytest.mark.parametrize("rows", [0, 1, 900])
def test_few_groups_are_covered(spark, scanned, rows):
    df = spark.range(rows).selectExpr("if(id % 5 = 0, null, id % 40) as k")
    assert [tuple(r) for r in heavy_groups(df, ["k"], 100).collect()] == ranked(df, ["k"], 100)
    assert len(scanned) == 1


def brute(rows, width):
    best = {}
    for ip, at in rows:
        if ip is None or at is None:
            continue
        n = sum(1 for other, t in rows if other == ip and t is not None and at - width < t <= at)
        if ip not in best or (n, -at) > best[ip]:
            best[ip] = (n, -at)
    return {ip: (n, -back) for ip, (n, back) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_peaks_over_all_windows(spark, seed):
    rng, width = random.Random(seed), 2_000_000
    span = width * CHUNK * 3
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(-span, span)) for _ in range(250)]
    for edge in range(-3, 4):  # rows on and around the edges of chunks, and repeats
        at = edge * width * CHUNK
        rows += [("edge", at), ("edge", at - 1), ("edge", at - width), ("edge", at - width + 1), ("edge", at), ("one" + str(edge), at)]
    rows += [(None, 5), ("a", None), ("never", None)]
    df = spark.createDataFrame(rows, "client_ip string, at long").withColumn("timestamp", F.timestamp_micros("at")).repartition(5)
    got = {r.client_ip: (r.peak, r.at) for r in peaks(df, 2).withColumn("at", F.unix_micros("peak_at")).collect()}
    assert got == brute(rows, width)


def test_a_busy_key_is_many_tasks(spark):
    df = spark.range(40_000).selectExpr("'hot' as client_ip", "timestamp_seconds(id * 30) as timestamp")
    plan = peaks(df, 120)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan.split("Window")[1]
    assert peaks(df, 120).first().peak == 4
    assert peaks(df.limit(0), 120).count() == 0

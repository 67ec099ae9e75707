import datetime as dt

from pyspark.sql import functions as F

from tests.test_upkeep import DAYS, batch, change, events
from visitlens.operators import changes as C
from visitlens.sources import sinks
from visitlens.streaming import kept


def exact(spark, path, *by):
    got = sinks.read_events(spark, path).groupBy(*by).agg(F.count("*").alias("requests"), F.countDistinct("client_ip").alias("visitors"))
    return sorted(tuple(r) for r in got.collect())


def test_parts_follow_replays_late_batches_and_relabelling(spark, tmp_path):
    path, parts = str(tmp_path / "events"), str(tmp_path / "kept")
    for n, some in ((0, "id < 30"), (1, "id >= 30"), (0, "id < 20"), (2, "id between 20 and 29")):
        batch(events(spark, 60).where(some), path, n)
        kept.keep_batch(spark, path, parts, n, DAYS)

    def same(*by):
        return sorted(tuple(r) for r in kept.summed(kept.read_parts(spark, parts), by).collect()) == exact(spark, path, *by)

    assert same() and same("bot_classification") and same("site")
    C.relabel(spark, path, change(spark, path, "new", "id % 2 = 0"), str(tmp_path / "runs"))
    assert not same("bot_classification")
    kept.rebuild(spark, path, parts, DAYS)
    assert same("bot_classification") and same()


def test_ranges_of_hours(spark, tmp_path):
    path, parts = str(tmp_path / "events"), str(tmp_path / "kept")
    df = spark.range(40_000).selectExpr(
        "id", "timestamp_seconds(1704067200 + id * 7) as timestamp", "concat('10.0.', id % 97, '.', id % 211) as client_ip", "'s' as site",
        "if(id % 3 = 0, 'a', 'b') as bot_classification", "'n' as bot_name",
    )
    batch(df, path, 0)
    kept.keep_batch(spark, path, parts, 0, [dt.date(2024, 1, d) for d in range(1, 6)])
    start, end = "2024-01-01 05:00:00", "2024-01-03 09:00:00"
    want = df.where(f"timestamp >= '{start}' and timestamp < '{end}'").agg(F.count("*"), F.countDistinct("client_ip")).first()
    got = kept.summed(kept.read_parts(spark, parts), (), start, end).first()
    assert got.requests == want[0] and abs(got.visitors - want[1]) < 0.03 * want[1]
    plan = kept.summed(kept.read_parts(spark, parts), (), start, end)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("]")[0]

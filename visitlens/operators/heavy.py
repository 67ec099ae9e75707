"""The most frequent groups without shuffling all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.metrics import requests
from visitlens.plans.common import top
from visitlens.streaming.scratch import staged

#: Groups that a task's summary tracks.
TRACKED = 10_000
#: Summaries are merged in two steps, as many at first.
MERGERS = 64
#: A summary of T tracked groups lists every group with more than this over T of all rows.
MISSED = 5.25


def heavy_groups(df: DataFrame, keys, limit: int, details: list[Column] = (), count: str = "count", tracked: int = TRACKED) -> DataFrame:
    """The ``limit`` most frequent groups of ``keys`` with exact counts and ``details``, as ranking all groups would give.

    Mergeable frequent-item summaries, one a task, propose at most ``tracked`` hashes of groups; only rows of these are
    grouped and counted. What is outside has at most the rows that the proposed groups leave over, and at most the
    summary's error. If the list's last group has more than that, the list is proven; otherwise, as with many groups of
    nearly one size, all groups are ranked. The proposals are broadcast, ``tracked`` numbers at most.
    """
    hashed = df.withColumn("_group", F.xxhash64(*keys))
    task = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_task")
    summaries = hashed.groupBy(task).agg(F.expr(f"approx_top_k_accumulate(_group, {tracked})").alias("summary"), requests("rows"))
    # Grouped, as there is no summary of no rows.
    merged = summaries.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"), F.sum("rows").alias("rows"))
    found = staged(merged.selectExpr(f"approx_top_k_estimate(summary, {tracked}) as items", "rows"), "summary")
    proposed = found.select(F.explode("items.item").alias("_group"))
    exact = staged(hashed.join(F.broadcast(proposed), "_group", "left_semi").groupBy(*keys).agg(requests(count), *details), "heavy")
    listed = top(exact, count, keys, limit)
    rows = found.agg(F.sum("rows")).first()[0] or 0
    covered = exact.agg(F.sum(count)).first()[0] or 0
    last, length = listed.agg(F.min(count), F.count(F.lit(1))).first()
    outside = min(rows - covered, int(MISSED * rows / tracked) + 1)
    if rows == covered or (length == limit and last > outside):
        return listed
    return top(df.groupBy(*keys).agg(requests(count), *details), count, keys, limit)

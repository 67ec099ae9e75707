"""Building blocks of the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.metrics import requests


def largest_first(by: str, keys) -> list[Column]:
    """Total order: the measure downwards, then every key."""
    return [F.col(by).desc(), *[F.col(k).asc_nulls_first() for k in keys]]


def top(df: DataFrame, by: str, keys, limit: int | None) -> DataFrame:
    """The ``limit`` largest groups, all of them if it is None."""
    ordered = df.orderBy(*largest_first(by, keys))
    return ordered if limit is None else ordered.limit(limit)


def rank_then_detail(
    df: DataFrame,
    keys,
    limit: int | None,
    details: list[Column],
    count: str = "count",
    at_least: int = 1,
) -> DataFrame:
    """The ``limit`` most frequent groups, with costly measures computed for those groups only.

    The first pass only counts, which combines on the map side whatever the group's size. Its
    result has at most ``limit`` rows; a second, column-pruned pass gathers distinct values and arrays,
    so neither touches the groups that do not make the list.
    """
    winners = top(df.groupBy(*keys).agg(requests(count)).where(F.col(count) >= at_least), count, keys, limit)
    winners = winners.select(*[F.col(k).alias(f"_{k}") for k in keys], count)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = df.join(winners, same)
    return top(rows.groupBy(*keys, count).agg(*details), count, keys, limit)


def evidence(df: DataFrame, report: DataFrame, keys, value: str, count: str = "count") -> DataFrame:
    """One row per group of a report and distinct value, with its requests.

    The arrays of a report are for groups with few values; this is the complete form for any.
    """
    wanted = report.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(requests(count))
    return rows.join(wanted, same, "left_semi")


def first_values(df: DataFrame, keys, value: str, n: int | None, name: str) -> DataFrame:
    """The first ``n`` distinct values of each group, in order, or all of them.

    The row-number filter is applied before the shuffle as a group limit, so no task receives more
    than ``n`` values per group and upstream task.
    """
    if n is None:
        return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))
    ordered = Window.partitionBy(*keys).orderBy(value)
    kept = df.select(*keys, value).distinct().withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") <= n)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))

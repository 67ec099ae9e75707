"""Small aggregate and arithmetic helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions.labels import col


def requests(name: str = "count") -> Column:
    return F.count(F.lit(1)).alias(name)


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def distinct(c: str, name: str, exact: bool = True) -> Column:
    """Exact distinct count, or the HyperLogLog estimate where an estimate is good enough."""
    return (F.count_distinct(F.col(c)) if exact else F.approx_count_distinct(c)).alias(name)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def active_seconds(ts: str = "timestamp") -> Column:
    """Seconds from the first to the last row of a group."""
    return seconds_between(F.min(ts), F.max(ts))


def fixed_round(c: Column, digits: int) -> Column:
    """Decimal half-up rounding, returned as a double."""
    return F.round(c.cast("decimal(38,18)"), digits).cast("double")


def percent(part: Column | str, whole: Column | str, digits: int) -> Column:
    return fixed_round(F.try_divide(col(part) * F.lit(100.0), col(whole)), digits)


def req_rate(n: Column | str, span: Column | str, zero: str = "count", digits: int = 4) -> Column:
    """Requests per second with a guard for an empty span.

    ``count`` reports the request count instead, ``null`` reports NULL, ``floor`` divides by at
    least one second.
    """
    n, span = col(n), col(span)
    if zero == "floor":
        return fixed_round(n / F.greatest(span, F.lit(1.0)), digits)
    rate = F.when(span > 0, fixed_round(F.try_divide(n, span), digits))
    return rate.otherwise(n.cast("double")) if zero == "count" else rate


def sorted_values(c: Column) -> Column:
    """Distinct values in order; NULL rather than an empty array when there are none."""
    values = F.sort_array(F.collect_set(c))
    return F.when(F.size(values) > 0, values)


BUCKETS = {"6h": 300, "24h": 3600, "7d": 7200, "30d": 86400}


def bucket_seconds(rng: str) -> int:
    return BUCKETS.get(rng, BUCKETS["24h"])


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the fixed-width bucket a timestamp falls in."""
    ts = col(ts)
    if seconds == 3600:
        return F.date_trunc("hour", ts)
    if seconds == 86400:
        return F.date_trunc("day", ts)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)

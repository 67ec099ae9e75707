"""Joining events to one-row-per-key attributes when a few keys own most events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.streaming.scratch import staged

#: A key with more than one part in ``SHARE`` of all events is heavy, so there are fewer than ``SHARE`` of them.
SHARE = 1_000
SALTS = 64


def spread_join(
    events: DataFrame, per_key: DataFrame, key: str, weight: str, how: str = "left", share: int = SHARE
) -> DataFrame:
    """Join on ``key`` with the events of heavy keys spread over many tasks.

    ``per_key`` has one row per key and says in ``weight`` how many events the key has; ``weight``
    is not returned. Adaptive execution can't split such a join, as no shuffle stands between the
    aggregation per key and the join; so heavy keys, and events without a key, are salted. The
    list of heavy keys is broadcast: by arithmetic it has fewer than ``share`` rows. ``per_key`` is computed
    once and staged, as the total, the list and the join all read it.
    """
    per_key = staged(per_key, "per-key")
    everything = per_key.agg(F.sum(weight)).scalar()
    hot = per_key.where(F.col(weight) * share > everything).select(key, F.lit(True).alias("_hot"))
    scattered = F.pmod(F.xxhash64(*_scatter(events, key)), F.lit(SALTS))
    spread = F.when(F.col("_hot") | F.col(key).isNull(), scattered).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = events.join(F.broadcast(hot), key, "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    right = per_key.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot", weight)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _scatter(events: DataFrame, key: str) -> list[str]:
    """Columns that differ between events of one key."""
    found = [c for c in ("id", "timestamp", "path", "value") if c in events.columns and c != key]
    return found or [c for c in events.columns if c != key]

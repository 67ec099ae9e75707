"""Change sets: what a relabelling run would write, and how it reaches the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.sinks import read_days, write_events
from visitlens.sources.upkeep import Conflict, Directory, commit, days_of, new_run, versions

# An id is a 64-bit hash; over very many events only id and time together name one of them.
ROW_KEYS = ("id", "event_date", "timestamp")


def apply_changes(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events with the changed columns replaced, NULL included, on the rows a change set names.

    Every column of ``changes`` that the events also have is written. The key names single rows,
    so the join is not skewed; copies of one event share a change, which is kept once.
    """
    keys = [k for k in ROW_KEYS if k in changes.columns and k in events.columns]
    written = [c for c in changes.columns if c in events.columns and c not in keys]
    patch = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in written])
    joined = events.join(patch.dropDuplicates(keys), keys, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in written else F.col(c)
            for c in events.columns
        ]
    )


def rewrite_partitions(spark: SparkSession, path: str, changes: DataFrame, out: str) -> str:
    """Writes the days a change set touches, patched, into a run's own folder below ``out``, and returns that folder.

    ``changes`` must carry ``event_date``. Only touched days are listed, read and written, and the table stays as it
    was; :func:`commit_partitions` puts them in. The versions of the directories are noted before they are read.
    """
    run, days = new_run(out), days_of(changes)
    versions(spark, path, days).write.parquet(f"{run}/base")
    events = read_days(spark, path, days)
    if events is not None:
        write_events(apply_changes(events, changes), f"{run}/events")
    return run


def commit_partitions(spark: SparkSession, run: str, path: str) -> list[Directory]:
    """Replaces the directories of ``path`` by those of a run; a commit that broke off is run again.

    Returns the directories it refuses, as they were written again after the run had read them.
    """
    return commit(spark, run, path)


def relabel(spark: SparkSession, path: str, changes: DataFrame, out: str) -> str:
    """A relabelling run that ends in the table: rewrite below ``out``, then commit. Returns the run's folder.

    Raises :class:`Conflict` with the directories that are to be relabelled anew.
    """
    run = rewrite_partitions(spark, path, changes, out)
    refused = commit_partitions(spark, run, path)
    if refused:
        raise Conflict(refused)
    return run


def transitions(changes: DataFrame) -> DataFrame:
    """How many rows move from which label to which."""
    return changes.groupBy("old_class", "new_class").agg(F.count(F.lit(1)).alias("count"))

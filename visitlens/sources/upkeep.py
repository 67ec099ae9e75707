"""Keeping the events table: versions of its directories, checked commits, compaction and retention.

A directory (day, batch) is known by the names and sizes of its files; Spark gives every file it writes a name of its
own, so a directory that was written again has another version. A run that rewrites directories works in a folder of
its own, notes the versions it was made from, and commits exactly those directories, and only while they still have
these versions. What it can't commit it refuses and names.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.operators.filters import as_timestamp
from visitlens.settings import DEFAULT
from visitlens.sources.sinks import LAYOUT, day_paths, read_days, read_events, write_events

#: Rows that a task of a merging run takes in and sorts, and so of a file that it writes.
MERGED_ROWS = 100_000
#: The directory that a day's batches are merged into. Loads have negative numbers too, but small ones.
COMPACTED = -(1 << 62)

Directory = tuple[dt.date, int]


class Conflict(RuntimeError):
    """Directories that were written again while a run worked on what they held before."""

    def __init__(self, refused: list[Directory]) -> None:
        super().__init__("rewritten since: " + ", ".join(f"{day}/{batch}" for day, batch in refused[:20]))
        self.refused = refused


def new_run(out: str) -> str:
    """A folder that no other run has."""
    return f"{out.rstrip('/')}/run-{uuid.uuid4().hex}"


def versions(spark: SparkSession, path: str, days: Iterable[dt.date]) -> DataFrame:
    """event_date, batch_id and version of the directories of some days; files are listed, not read."""
    there = day_paths(spark, path, days)
    if not there:
        return spark.createDataFrame([], "event_date date, batch_id long, version string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(there)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    named = F.concat_ws(":", F.substring_index("path", "/", -1), "length")
    found = files.select(part("event_date").cast("date").alias("event_date"), part("batch_id").cast("long").alias("batch_id"), named.alias("file"))
    return found.groupBy(*LAYOUT).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("file")), ","), 256).alias("version"))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of a frame, maps as sorted entries."""
    return [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]


def contents(df: DataFrame) -> DataFrame:
    """Rows of each directory and the sum of their hashes: equal for equal rows in any order."""
    own = F.xxhash64(*[c for c, f in zip(hashable(df), df.schema.fields, strict=True) if f.name not in LAYOUT])
    return df.groupBy(*LAYOUT).agg(F.count(F.lit(1)).alias("n"), F.sum(own.cast("decimal(20,0)")).alias("hashes"))


def days_of(df: DataFrame) -> list[dt.date]:
    """The days of a frame: one value a day."""
    return sorted(r[0] for r in df.select("event_date").distinct().collect() if r[0] is not None)


def _listed(df: DataFrame) -> list[Directory]:
    return sorted((r.event_date, r.batch_id) for r in df.collect())


def _equal(spark: SparkSession, path: str, run: str, which: DataFrame) -> DataFrame:
    """Of some directories those that hold in the table what the run has written for them."""
    there = read_days(spark, path, days_of(which))
    if there is None:
        return which.limit(0)
    ours, theirs = (contents(df.join(F.broadcast(which), list(LAYOUT), "left_semi")) for df in (read_events(spark, f"{run}/events"), there))
    return ours.join(theirs, [*LAYOUT, "n", "hashes"]).select(*LAYOUT)


def commit(spark: SparkSession, run: str, path: str) -> list[Directory]:
    """Puts a run's directories into the table and returns those it refuses.

    A directory goes in if the table's still has the version that the run was made from. A commit that broke off is
    run again: directories that hold the run's rows already are done. The manifest has a row for each directory.
    """
    base = spark.read.parquet(f"{run}/base")
    now = versions(spark, path, days_of(base)).withColumnRenamed("version", "now")
    state = base.join(now, list(LAYOUT), "left")
    same = state.where("version = now").select(*LAYOUT)
    todo, changed = _listed(same), state.where("now is null or version != now").select(*LAYOUT)
    refused = _listed(changed.join(_equal(spark, path, run, changed), list(LAYOUT), "left_anti")) if not changed.isEmpty() else []
    if todo:
        listed = spark.createDataFrame(todo, "event_date date, batch_id long")
        write_events(read_events(spark, f"{run}/events").join(F.broadcast(listed), list(LAYOUT), "left_semi"), path)
    return refused


# Compaction.


def merge_days(spark: SparkSession, path: str, out: str, days: Iterable[dt.date]) -> str:
    """Writes the stream's batches of each of some closed days, merged, into a run's folder, and returns that.

    Loads keep directories of their own, as a load that is repeated replaces its directory. Rows are dealt by day and
    id into ranges of one size, so a busy day is no large task, nor one block that a task fetches, and small days share tasks.
    """
    run, days = new_run(out), sorted(days)
    mergeable = (F.col("batch_id") >= 0) | (F.col("batch_id") == COMPACTED)
    base = versions(spark, path, days).where(mergeable)
    # A day with one directory is as it should be.
    several = base.groupBy("event_date").agg(F.max("batch_id").alias("newest"), F.count(F.lit(1)).alias("n")).where(f"n > 1 or newest > {COMPACTED}")
    base.join(several.select("event_date"), "event_date", "left_semi").write.parquet(f"{run}/base")
    wanted = spark.read.parquet(f"{run}/base").select(*LAYOUT)
    events = read_days(spark, path, days_of(wanted))
    if events is not None:
        merged = events.join(F.broadcast(wanted), list(LAYOUT), "left_semi").withColumn("batch_id", F.lit(COMPACTED).cast("long"))
        write_events(merged.repartitionByRange(merged.count() // MERGED_ROWS + 1, "event_date", "id", "timestamp"), f"{run}/events")
    return run


def commit_merged(spark: SparkSession, run: str, path: str) -> list[Directory]:
    """Puts merged days in, removes what they were merged from and returns what it refuses.

    The merged directory is written first, so a commit that breaks off leaves rows twice, not lost, until it is run
    again. A day of which any directory was written again since is left as it is. A batch of the stream that is replayed
    afterwards finds its rows in the merged directory and adds none.
    """
    base = spark.read.parquet(f"{run}/base")
    days = days_of(base)
    if not days:
        return []
    now = versions(spark, path, days).withColumnRenamed("version", "now")
    merged = base.select("event_date").distinct().withColumn("batch_id", F.lit(COMPACTED).cast("long"))
    done = set(days_of(_equal(spark, path, run, merged)))
    sources = base.join(now, list(LAYOUT), "left").collect()
    changed = [(r.event_date, r.batch_id) for r in sources if r.now != r.version and r.batch_id != COMPACTED]
    # Of a day that is in already, sources that are gone are done as well.
    gone = {(r.event_date, r.batch_id) for r in sources if r.now is None}
    grown = {r.event_date for r in sources if r.batch_id == COMPACTED and r.now != r.version} - done
    refused = sorted(d for d in changed if d[0] not in done or d not in gone) + [(day, COMPACTED) for day in sorted(grown)]
    todo = sorted(set(days) - done - {day for day, _ in refused})
    if todo:
        write_events(read_events(spark, f"{run}/events").where(F.col("event_date").isin(todo)), path)
    for r in sources:
        if r.batch_id != COMPACTED and r.now == r.version and (r.event_date in done or r.event_date in todo):
            remove_folder(spark, f"{path}/event_date={r.event_date}/batch_id={r.batch_id}")
    return refused


def compact(spark: SparkSession, path: str, out: str, days: Iterable[dt.date]) -> str:
    """Merges the batches of closed days in the table; raises ``Conflict`` with what was written again meanwhile."""
    run = merge_days(spark, path, out, days)
    refused = commit_merged(spark, run, path)
    if refused:
        raise Conflict(refused)
    return run


# Retention.


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when they were changed, in milliseconds."""
    place, fs = _place(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(place)] if fs.exists(place) else []


def _days(names: Iterable[tuple[str, int]]) -> list[dt.date]:
    """The days that directories are named after."""
    return sorted(dt.date.fromisoformat(n.partition("=")[2]) for n, _ in names if n.startswith("event_date=") and n[11:].replace("-", "").isdigit())


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days that have a directory."""
    return _days(names(spark, path))


def loading_days(spark: SparkSession, path: str, stale: dt.timedelta = dt.timedelta(days=1)) -> set[dt.date]:
    """Days that a running job writes: Spark gathers the directories of a job in a folder in the table until it commits.

    Folders that nothing has changed for ``stale`` are left-overs of a job that broke off.
    """
    since = (dt.datetime.now(dt.timezone.utc) - stale).timestamp() * 1000
    found: set[dt.date] = set()
    for name, changed in names(spark, path):
        if name.startswith(".spark-staging-") and changed >= since:
            tasks = f"{path}/{name}/_temporary/0"
            places = [f"{path}/{name}", *[f"{tasks}/{n}" for n, _ in names(spark, tasks)]]
            places += [f"{tasks}/_temporary/{n}" for n, _ in names(spark, f"{tasks}/_temporary")]
            for place in places:
                found.update(_days(names(spark, place)))
    return found


def expire_days(spark: SparkSession, path: str, as_of: dt.datetime | str, days: int = DEFAULT.retention_days) -> list[dt.date]:
    """Removes the directories of days outside the retention period by name and returns these days.

    No file is read. Days that a running job writes stay until a later run; a run that breaks off is run again.
    """
    last = (as_timestamp(as_of) - dt.timedelta(days=days)).date()
    expired = [day for day in stored_days(spark, path) if day <= last]
    busy = loading_days(spark, path) if expired else set()
    gone = [day for day in expired if day not in busy]
    for day in gone:
        remove_folder(spark, f"{path}/event_date={day}")
    return gone

"""Sinks: the partitioned events table, progress rows and CSV export."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.requests import event_key
from visitlens.schema import BACKFILL_COLUMNS, STORED_EVENT

TABLE = T.StructType([*STORED_EVENT.fields, T.StructField("batch_id", T.LongType())])


def to_stored(df: DataFrame) -> DataFrame:
    """Projects to the stored layout; absent columns become NULL, the two bot flags default to false."""
    if "id" not in df.columns:
        df = df.withColumn("id", event_key(df.columns))
    df = df.withColumn("event_date", F.to_date("timestamp"))
    defaults = {"is_bot", "has_cf_worker", "is_exploit_attempt"}
    columns = []
    for field in STORED_EVENT.fields:
        missing = F.lit(False) if field.name in defaults else F.lit(None)
        value = F.col(field.name) if field.name in df.columns else missing
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def to_backfilled(df: DataFrame) -> DataFrame:
    """The columns a historical load writes, in the stored layout."""
    keep = [c for c in BACKFILL_COLUMNS if c in df.columns]
    extra = [c for c in ("id", "detection_reason") if c in df.columns]
    if "id" not in df.columns:
        df, extra = df.withColumn("id", event_key(df.columns)), ["id", *extra]
    return to_stored(df.select(*extra, *keep))


# Directories of the events table. Every writer uses them: a stream numbers its batches from 0, loads have
# negative numbers. Whoever writes a number again replaces what it wrote before.
LAYOUT = ("event_date", "batch_id")


def write_events(stored: DataFrame, path: str) -> None:
    """Writes rows of the stored layout with their ``batch_id``, replacing the directories they belong to."""
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def append_events(df: DataFrame, path: str, load_id: int | None = None, compact: bool = False) -> None:
    """Adds a load to the events table.

    A load that is repeated under its ``load_id`` (negative) replaces itself; without one it gets a new
    number. Logs arrive nearly in time order, so a task writes few days and nothing is shuffled. For
    input that mixes many days ``compact`` gathers each day first; adaptive execution sizes the files
    and splits busy days.
    """
    number = -(time.time_ns() // 1000) if load_id is None else load_id
    if number >= 0:
        raise ValueError("numbers from 0 belong to the ingestion stream")
    stored = to_stored(df).withColumn("batch_id", F.lit(number).cast("bigint"))
    write_events(stored.hint("rebalance", "event_date") if compact else stored, path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table, whoever wrote it."""
    return spark.read.schema(TABLE).parquet(path)


def day_paths(spark: SparkSession, path: str, days) -> list[str]:
    """Directories of those of some days that the table has."""
    # Asking a store for a few known directories needs its own interface; listing the table would not scale.
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day}") for day in days]
    conf = spark._jsc.hadoopConfiguration()
    return [p.toString() for p in paths if p.getFileSystem(conf).exists(p)]


def read_days(spark: SparkSession, path: str, days) -> DataFrame | None:
    """The events of some days; only their directories are listed. None if the table has none of them."""
    there = day_paths(spark, path, days)
    return spark.read.schema(TABLE).option("basePath", path).parquet(*there) if there else None


def batch_metrics(df: DataFrame, started: Column | None = None) -> DataFrame:
    """One progress row for a batch: newest event, its ray id, row count and elapsed time."""
    now = F.current_timestamp()
    elapsed = F.lit(None).cast("long") if started is None else (F.unix_millis(now) - F.unix_millis(started))
    return df.agg(
        F.max("timestamp").alias("last_processed_timestamp"),
        F.max_by("cf_ray", "timestamp").alias("last_cf_ray"),
        F.count(F.lit(1)).alias("records_processed"),
    ).select("*", elapsed.alias("ingestion_duration_ms"), now.alias("created_at"))


def title_names(df: DataFrame) -> DataFrame:
    """Headings from column names: blanks for underscores, words capitalised."""
    return df.toDF(*[" ".join(w[:1].upper() + w[1:] for w in c.split("_")) for c in df.columns])


def csv_ready(df: DataFrame) -> DataFrame:
    """Every value as text: arrays joined with ``; ``, NULL left empty."""
    columns = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), "; ")
        columns.append(value.cast("string").alias(field.name))
    return title_names(df.select(*columns))


def quoted(value: Column) -> Column:
    """A CSV field: quotes doubled and the value quoted, nothing at all for NULL."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame) -> DataFrame:
    """The lines of a CSV file, heading first; every value is quoted, NULL stays empty."""
    text = csv_ready(df)
    heading = ",".join('"' + c.replace('"', '""') + '"' for c in text.columns)
    fields = [F.coalesce(quoted(F.col(f"`{c}`")), F.lit("")) for c in text.columns]
    rows = text.select(F.concat_ws(",", *fields).alias("value"))
    return df.sparkSession.createDataFrame([(heading,)], "value string").coalesce(1).union(rows)


def export_csv(df: DataFrame, path: str) -> None:
    """Writes the lines as part files that, joined in name order, are one CSV file.

    Spark's CSV writer cannot leave NULL unquoted among quoted values, so lines are written as text.
    """
    csv_lines(df).write.mode("overwrite").text(path)


def sort_for_display(df: DataFrame, column: str) -> DataFrame:
    """Sort by a chosen column: numbers downwards, anything else as text upwards."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    key = F.col(column).desc() if numeric else F.col(column).cast("string").asc()
    rest = [c for c in df.columns if c != column and not isinstance(df.schema[c].dataType, T.MapType)]
    return df.orderBy(key, *rest)

"""Helpers that several operators share: staged tables, joins with hot keys, bounded filters, ranks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter that ``may_contain`` broadcasts: 4 MB, whatever the data.
FILTER_BITS = 1 << 25
#: Bits in one bitmap row of ``bitmap_construct_agg``.
_ROW_BITS = 32768

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total(df: DataFrame, column: Column | None = None) -> int:
    """One number: the rows of ``df``, or the sum of a column."""
    value = df.agg(F.count(F.lit(1)) if column is None else F.sum(column)).first()[0]
    return int(value or 0)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, parts: int = 2000) -> DataFrame:
    """Left join of ``rows`` with one row per ``key`` of ``groups``; heavy keys take no part in the shuffle.

    Keys with more than 1/``parts`` of all rows number fewer than ``parts`` by arithmetic; only these are broadcast.
    The key must not be null in ``groups``. ``groups`` must be cheap to read twice (a staged table).
    """
    limit = max(1, total(groups, F.col(size)) // parts)
    extra = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit).withColumnsRenamed({c: f"hot_{c}" for c in extra})
    # Always 0, but no constant: the planner would drop a constant from the keys that the rows are dealt by.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    rest = groups.filter(F.col(size) <= limit).withColumn("spread", zero).withColumnRenamed(key, "rest_key")
    # Rows of a heavy key have their answer already: they go anywhere, to find nothing.
    anywhere = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int") + 1
    first = rows.join(F.broadcast(hot), key, "left")
    # So do rows without a key.
    first = first.withColumn("row_spread", F.when(F.col(f"hot_{size}").isNull() & F.col(key).isNotNull(), 0).otherwise(anywhere))
    both = first.join(rest, (F.col(key) == F.col("rest_key")) & (F.col("row_spread") == F.col("spread")), "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in extra])


def with_maybe(rows: DataFrame, row_hash: str, keys: DataFrame, key_hash: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``maybe``: false where a row's 64-bit hash is surely not among ``keys``, by a broadcast bitmap of fixed size."""
    slot = F.pmod(F.col(key_hash), F.lit(bits))
    maps = keys.groupBy((slot / _ROW_BITS).cast("long").alias("map_no")).agg(
        F.bitmap_construct_agg(F.pmod(slot, F.lit(_ROW_BITS))).alias("map_bits")
    )
    byte = F.conv(F.hex(F.expr("substring(map_bits, cast(map_at % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("long")
    return (
        rows.withColumn("map_at", F.pmod(F.col(row_hash), F.lit(bits)))
        .withColumn("map_no", (F.col("map_at") / _ROW_BITS).cast("long"))
        .join(F.broadcast(maps), "map_no", "left")
        .select(*rows.columns, F.coalesce(F.getbit(byte, (F.col("map_at") % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))
    )


def may_contain(rows: DataFrame, row_hash: str, keys: DataFrame, key_hash: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose hash may be among ``keys``. It only saves traffic before a join that decides."""
    return with_maybe(rows, row_hash, keys, key_hash, bits).filter("maybe").drop("maybe")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash (``row_key`` of ``gone``, a staged table) are listed.

    Rows that are surely not listed pass by; only the others are shuffled.
    """
    marked = with_maybe(packed(docs, row_key().alias("row_key")), "row_key", gone, "row_key")
    rest = marked.filter("maybe").join(gone.select("row_key").distinct(), "row_key", "left_anti")
    return marked.filter("not maybe").select("row.*").unionByName(rest.select("row.*"))


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """``row``, a struct of all columns, and columns of an operator's own, which so meet none of the caller's names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)


def row_key() -> Column:
    """A 64-bit key of doc_id and text; rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.col("doc_id").isNull())


def release() -> None:
    """Gives freed memory back: Spark keeps a worker for later stages, and allocators keep what a stage has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator of batches that gives its memory back when it ends."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return inner


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text: lower case for A-Z, split at ASCII white space."""
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

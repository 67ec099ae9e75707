"""Exact deduplication: fingerprints travel Golomb-coded, bitmaps come back, and only suspects' texts move.

Every task sorts the 64-bit fingerprints of its rows, splits them by range among the owners and sends each its
sorted list in Golomb-Rice code. An owner answers every list with a bitmap of the fingerprints that another
list holds too; what repeats inside a list its sender has marked already. The texts behind the marked
fingerprints are then shuffled and compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.shared import attach, may_contain, releasing, stage, total

#: Fingerprints that a task sorts and sends at a time.
CHUNK = 1 << 22
#: Fingerprints for an owner at most; fewer while there are less than so many owners, but so many at least.
OWNED, OWNERS, LEAST = 1 << 24, 64, 1 << 12


def owners_for(n: int) -> int:
    """Owners of hash ranges for ``n`` fingerprints."""
    return max(1, math.ceil(n / OWNED), min(OWNERS, math.ceil(n / LEAST)))


def golomb(values: np.ndarray) -> bytes:
    """Sorted, distinct uint64 values in Golomb-Rice code: head, quotients in unary, remainders of fixed width."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1])
    k = min(57, max(0, int(math.log2(max(1.0, float(gaps[1:].mean()) if len(gaps) > 1 else 1.0)))))
    high, low = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    ones = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    bits = (low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    head = np.array([len(values), k, len(unary), values[0]], np.uint64)
    return head.astype("<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(bits.astype(np.uint8)).tobytes()


def ungolomb(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    n, k, length, first = (int(x) for x in np.frombuffer(data, "<u8", 4))
    split = 32 + (length + 7 >> 3)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data[32:split], np.uint8), count=length))
    high = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data[split:], np.uint8), count=n * k).reshape(n, k)
    low = (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(k)) | low
    gaps[0] = first
    return np.cumsum(gaps, dtype=np.uint64)


def messages(fingerprints: DataFrame, owners: int, chunk: int) -> DataFrame:
    """Of a column of longs: a row for each task, chunk and owner, with the coded list and marks of local repeats."""
    names = ["sender", "owner", "n", "payload", "repeats"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, sent = TaskContext.get().partitionId(), [], 0, 0

        def send(parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sent
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            width = (1 << 64) // owners + 1
            owner = (values // np.uint64(width)).astype(np.int64) if owners > 1 else np.zeros(len(values), np.int64)
            found, starts = np.unique(owner, return_index=True)
            ends = [*starts[1:].tolist(), len(values)]
            rows = [
                ((task << 24) + sent, o, e - s, golomb(values[s:e]), np.packbits(counts[s:e] > 1).tobytes())
                for o, s, e in zip(found.tolist(), starts.tolist(), ends, strict=True)
            ]
            sent += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += batch.num_rows
            if n >= chunk:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return fingerprints.mapInArrow(run, "sender long, owner int, n long, payload binary, repeats binary")


def reply(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers: for each list the bitmap of fingerprints that other lists hold."""
    values = [ungolomb(x) for x in lists["payload"]]
    together, counts = np.unique(np.concatenate(values), return_counts=True)
    shared = together[counts > 1]
    marks = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in values]
    return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "marks": marks})


def suspects(fingerprints: DataFrame, owners: int, chunk: int | None = None) -> DataFrame:
    """The distinct fingerprints that occur more than once, by the exchange."""
    chunk = chunk or CHUNK
    sent = stage(messages(fingerprints, owners, chunk), "fingerprints")
    replies = sent.select("sender", "owner", "payload").groupBy("owner").applyInPandas(reply, "sender long, owner int, marks binary")

    @releasing
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.frombuffer(row["marks"], np.uint8) | np.frombuffer(row["repeats"], np.uint8)
                values = ungolomb(row["payload"])[np.unpackbits(marks, count=row["n"]).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["fingerprint"])

    marked = sent.join(replies, ["sender", "owner"]).select("n", "payload", "repeats", "marks")
    return marked.mapInArrow(apply, "fingerprint long").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which of its equal texts stays.

    The row with the largest doc_id stays. A null text equals the empty text. Null doc_ids are smaller than any
    other; rows that repeat a doc_id and its text get the same answer. Other columns are ignored; an empty table
    gives none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = stage(suspects(rows.select(F.xxhash64("text")), owners_for(total(rows))), "suspects")
    texts = may_contain(rows.withColumn("fingerprint", F.xxhash64("text")), "fingerprint", marked, "fingerprint")
    equal = texts.groupBy("fingerprint", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(
        equal.filter("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "equal-texts"
    )
    found = attach(rows.select("doc_id", F.sha2("text", 256).alias("text_sha256")), groups, "text_sha256", "group_size")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )

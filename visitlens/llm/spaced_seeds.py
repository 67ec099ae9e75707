"""Benchmark decontamination with spaced seeds.

A mask names the word positions of a span that count; the others may differ, so a passage with replaced words
still shares seeds. The masks miss no overlap that the rule admits, wherever its words differ. Seeds of the
benchmark and of the documents are joined on their hash, hits on one diagonal are put together, and the words
around them are compared position by position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.shared import mix, row_key, stage, without, word_hashes

#: Positions of a span that count. One of them fits into every overlap of 13 words with two differing, 15 with three,
#: 20 with four and 25 with five; any longer overlap holds one of 13 to 25 words.
MASKS = ("1101111", "11100010011", "1010000101011")
#: An overlap counts from so many words on, or from the whole item if that is shorter, with such a share equal.
WORDS, EQUAL = 13, 0.8
#: Shorter items are too common to decide anything.
SHORTEST = 5
#: A differing word needs so many equal ones beside it.
MISMATCH = round(EQUAL / (1 - EQUAL))
#: Bits of the filter that spares hits without a partner: 2 MB, whatever the benchmark.
SEED_BITS = 1 << 24


def short_masks(length: int) -> list[str]:
    """Masks for items under ``WORDS`` words: five blocks, less as many of them as words may differ."""
    blocks = np.arange(length) * 5 // length
    return ["".join("01"[b not in gone] for b in blocks) for gone in combinations(range(5), length // (MISMATCH + 1))]


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash for each start of the mask's span."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, number, np.uint64)
    for place, on in enumerate(mask):
        if on == "1":
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[place : place + n])
    return total


def masks_for(items: DataFrame, masks: Sequence[str]) -> list[tuple[str, int]]:
    """The masks, with 0, and those of each length of shorter items that occurs, with that length: 58 at most."""
    short = items.filter((F.size("words") < WORDS) & (F.size("words") >= SHORTEST)).select(F.size("words")).distinct()
    return [*((m, 0) for m in masks), *((m, n) for (n,) in sorted(short.collect()) for m in short_masks(n))]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and the word hashes of each benchmark text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t.as_py() or "").view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words array<bigint>").filter(F.size("words") >= SHORTEST)


def item_seeds(items: DataFrame, masks: list[tuple[str, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1), strict=True):
                own = np.asarray(words.as_py(), np.int64).view(np.uint64)
                for number, (mask, length) in enumerate(masks):
                    if length != (len(own) if len(own) < WORDS else 0):
                        continue
                    found = seeds(own, mask, number)
                    places = pa.array(np.arange(len(found), dtype=np.int32))
                    items_ = pa.array([item.as_py()] * len(found), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), items_, places], ["seed", "item_id", "item_at"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"seed bigint, item_id {kind}, item_at int").distinct()


def slots(seeds_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of a seed in the filter: its lower and its upper half."""
    return (seeds_ & np.uint64(bits - 1)).astype(np.int64), (seeds_ >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64)


def seed_filter(table: DataFrame, bits: int = SEED_BITS) -> np.ndarray:
    """Bits for the two slots that each benchmark seed falls into; its size doesn't depend on the benchmark."""
    both = F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("seed", 40).bitwiseAND(F.lit(bits - 1)))
    rows = (
        table.select(F.explode(both).alias("slot"))
        .groupBy((F.col("slot") / 32768).cast("int").alias("no"))
        .agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
        .collect()
    )
    found = np.zeros((bits // 32768, 4096), np.uint8)
    for row in rows:
        found[row["no"]] = np.frombuffer(row["bits"], np.uint8)
    return found.reshape(-1)


def hit_stretches(docs: DataFrame, masks: list[tuple[str, int]], present: np.ndarray, reach: int) -> DataFrame:
    """Stretches of documents around possible hits: their words, and the seeds that hit with their places.

    Stretches of a document are as far apart as an item can reach, so an overlap lies in one of them.
    """
    bits = len(present) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = word_hashes(text.as_py() or "")
                found, places = [], []
                for number, (mask, _) in enumerate(masks):
                    own = seeds(words, mask, number)
                    one, two = slots(own, bits)
                    at = np.flatnonzero(present[one >> 3] >> (one & 7).astype(np.uint8) & present[two >> 3] >> (two & 7).astype(np.uint8) & 1)
                    found.append(own[at])
                    places.append(at)
                at = np.concatenate(places)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hash_ = at[order], np.concatenate(found)[order].view(np.int64)
                cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                for own_at, own_hash in zip(np.split(at, cuts), np.split(hash_, cuts), strict=True):
                    begin, end = max(0, own_at[0] - reach), min(len(words), own_at[-1] + reach)
                    rows.append((key.as_py(), int(begin), words[begin:end].view(np.int64), own_hash, own_at.astype(np.int32)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row_key", "begin", "words", "seeds", "places"]
                )

    return docs.select(row_key(), "text").mapInArrow(
        run, "row_key bigint, begin int, words array<bigint>, seeds array<bigint>, places array<int>"
    )


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Length, equal words and begin (in the document) of the longest overlap on one diagonal, or zeros.

    Every stretch of at least ``WORDS`` words (or the whole shorter item) with a share of ``EQUAL`` is an overlap.
    Differing words at the ends of the longest one are left out as far as enough words remain.
    """
    least = min(WORDS, len(item))
    begin, end = max(0, shift), min(len(doc), shift + len(item))
    if end - begin < least:
        return 0, 0, 0
    equal = doc[begin:end] == item[begin - shift : end - shift]
    ups = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    # By end: the first place whose sum isn't above the one at the end.
    firsts = np.searchsorted(-np.minimum.accumulate(ups), -ups)
    lengths = np.arange(len(ups)) - firsts
    last = int(np.argmax(lengths))
    first = int(firsts[last])
    if last - first < least:
        return 0, 0, 0
    while last - first > least and not equal[last - 1]:
        last -= 1
    while last - first > least and not equal[first]:
        first += 1
    return last - first, int(equal[first:last].sum()), begin + first


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """For each contaminated document and item: row_key, item_id, overlap in words, equal words and begin.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null and empty texts
    overlap with nothing, and items under ``SHORTEST`` words take no part. Repeated documents are compared once.
    """
    items = stage(item_words(benchmark), "items")
    used = masks_for(items, masks)
    table = stage(item_seeds(items, used), "item-seeds")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    reach = longest + max(len(mask) for mask, _ in used)
    stretches = stage(hit_stretches(docs, used, seed_filter(table), reach).dropDuplicates(["row_key", "begin"]), "stretches")
    hits = stretches.select("row_key", "begin", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    pairs = (
        hits.select("row_key", "begin", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
        .join(table, "seed")
        .select("row_key", "begin", "item_id", (F.col("at") - F.col("item_at") - F.col("begin")).alias("shift"))
        .distinct()
    )
    both = pairs.join(stretches.select("row_key", "begin", "words"), ["row_key", "begin"]).join(
        items.withColumnRenamed("words", "item"), "item_id"
    )
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, begin, item_id, shift, words, item in zip(*batch.columns, strict=True):
                own = np.asarray(item.as_py(), np.int64)
                length, equal, at = best_overlap(np.asarray(words.as_py(), np.int64), own, shift.as_py())
                if length:
                    rows.append((key.as_py(), item_id.as_py(), length, equal, begin.as_py() + at))
            if rows:
                kinds = [pa.int64(), batch.schema.field(2).type, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row_key", "item_id", "overlap", "equal", "at"]
                )

    checked = both.select("row_key", "begin", "item_id", "shift", "words", "item").mapInArrow(
        run, f"row_key bigint, item_id {kind}, overlap int, equal int, at int"
    )
    best = checked.groupBy("row_key", "item_id").agg(F.max(F.struct("overlap", "equal", F.col("at").alias("at"))).alias("best"))
    return best.select("row_key", "item_id", "best.*")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: whether it holds benchmark text, of which items, and its longest overlap."""
    found = contaminated(docs, benchmark).groupBy("row_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").cast("long").alias("overlap_words")
    )
    rows = docs.select("doc_id", row_key().alias("row_key")).join(found, "row_key", "left")
    return rows.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"),
        F.coalesce("overlap_words", F.lit(0)).cast("long").alias("overlap_words"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark text, with all their columns."""
    return without(docs, stage(contaminated(docs, benchmark).select("row_key").distinct(), "contaminated"))

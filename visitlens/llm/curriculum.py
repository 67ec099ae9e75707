"""Mixing sources to target weights along a curriculum that changes with training time.

Each source has a share of all words and a weight schedule, a line through knots over training time 0 to 1.
The integral of the schedule, scaled to the share, is the source's cumulative demand; its documents are laid
along that demand in a fixed random order, as often as the share needs, and the inverse of the demand gives
every copy its training position. Copies are range-sorted by position. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.shared import WORD, packed, stage, total

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules of the sources in code point order, repeating: knots of (time, weight), from time 0 to 1.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)
#: A source is taken so many times at most.
REPEATS = 3
#: Rows that one window of the running sum should hold.
RUN = 4096


def sized(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, source, size in words, and the digest that orders the documents of a source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"), *extra)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """A row for each source: its size, rank in code point order (null last), weight and target in words.

    The targets add up to all words. One that would exceed ``repeats`` times its source's size stops there, and
    the excess goes to the others by weight: in order of cap by weight, those before the level are full.

    The windows over sources have no partition, so one task holds a row for each source. That is meant for up to a
    million sources, however many documents they have; more give the same results, more slowly.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.lit(repeats) * F.col("source_size")
    by_level = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    words = F.sum("source_size").over(everything)
    return (
        sources.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("level", cap / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum(cap).over(by_level), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("full", F.col("level") <= (words - F.col("full_before")) / F.col("weight_left"))
        .withColumn("left", words - F.sum(F.when(F.col("full"), cap).otherwise(0)).over(everything))
        .withColumn("shared", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * (F.col("left") / F.col("shared"))))
        .select("source", "source_size", "place", "weight", "target")
    )


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which the integral of the schedule reaches a share of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    area, before, result = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), own in zip(knots, knots[1:], areas, strict=False):
        pieces.append((before, t0, t1, w0, w1))
        before += own
    for begin, t0, t1, w0, w1 in reversed(pieces):
        rest = F.greatest(share * area - begin, F.lit(0.0))
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        time = F.lit(t0) + F.when(root > 0, F.least(2 * rest / root, F.lit(t1 - t0))).otherwise(0.0)
        end = begin + (t1 - t0) * (w0 + w1) / 2
        result = F.when(share * area < end, time).otherwise(result)
    return result


def assign(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    repeats: int = REPEATS,
) -> DataFrame:
    """``sizes`` (a staged table of ``sized``) with source_size, target, taken and the position of every copy.

    A copy is taken if its middle lies within the target. The running sum of a source is split by the first
    digits of the digest, so a source with most of the rows is no task of its own.
    """
    digits = max(1, (max(1, total(sizes) // RUN).bit_length() + 3) // 4)
    rows = sizes.withColumn("run", F.substring("digest", 1, digits))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = runs.withColumn("run_begin", F.coalesce(F.sum("run_size").over(before), F.lit(0))).drop("run_size")
    goal = targets(sizes, weights, repeats)
    known = begins.join(goal, begins["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    inside = Window.partitionBy("source", "run").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = placed.join(known, placed["source"].eqNullSafe(known["source"]) & (placed["run"] == known["run"]))
    both = both.drop(known["source"]).drop(known["run"])
    begin = F.col("run_begin") + F.col("inside")
    middles = F.array([2 * (begin + F.lit(e) * F.col("source_size")) + F.col("size") for e in range(repeats)])
    both = both.withColumn("middles", F.filter(middles, lambda m: (m <= 2 * F.col("target")) & (F.col("size") > 0)))

    def time(middle: Column) -> Column:
        share, found = middle / (2 * F.col("target")), F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            found = F.when(F.col("place") % len(schedules) == i, inverse_demand(share, knots)).otherwise(found)
        return found

    return both.withColumn("positions", F.transform("middles", time)).withColumn("taken", F.col("size") * F.size("middles"))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text), range-sorted by the position of its first copy.

    A null text has no words; rows without words are not taken and come last, like those that the mix has no
    room for. A null source is a source. Rows that repeat a doc_id are documents of their own; an empty table
    gives none; other columns are ignored.
    """
    found = assign(stage(sized(docs), "sizes"))
    first = F.when(F.size("positions") > 0, F.col("positions")[0])
    rows = found.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"), first.alias("position"))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position."""
    rows = stage(packed(docs, F.monotonically_increasing_id().alias("row_no")), "mix-input")
    chosen = assign(stage(sized(rows.select("row_no", "row.doc_id", "row.source", "row.text"), "row_no"), "sizes")).filter(F.size("positions") > 0).select("row_no", "positions")
    copies = rows.join(chosen, "row_no").select("row", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position").select("row.*")

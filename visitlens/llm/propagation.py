"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) should share a shard, and the shards must hold equally many
rows. Linked documents start anywhere; in every round a group votes with its members' shards, and members move
to the group's strongest shard that still has room, as far as its quota of free rows admits. A group larger than
a shard so fills one shard after another. Documents without links then fill the shards up, and what lies over
a shard's quota moves along with them, so that counts differ by one at most. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.shared import attach, stage, total

#: Rounds of propagation; it ends earlier when nothing moves.
ROUNDS = 8
#: Rows that one window of a running count should hold, at least and at most.
RUN = (64, 4096)
#: Steps of an admission quota.
STEPS = 1 << 20


def by_text(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the link key of equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("link"),
    )


def chance(*columns: Column) -> Column:
    """A fixed number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*columns), F.lit(STEPS)) / STEPS


def ranked(rows: DataFrame, within: list[str], order: list[str], splits: list[str], name: str) -> DataFrame:
    """Adds a gapless rank from 0 within ``within``; rows are in the order of ``splits``, then ``order``.

    Counts of the splits, added up, give every split its first rank, so no window holds more than one split.
    """
    staged = stage(rows, "to-rank")
    counts = staged.groupBy(*within, *splits).agg(F.count(F.lit(1)).alias("split_n"))
    before = Window.partitionBy(*within).orderBy(*splits).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("split_begin", F.coalesce(F.sum("split_n").over(before), F.lit(0))).drop("split_n")
    inside = F.row_number().over(Window.partitionBy(*within, *splits).orderBy(*order)) - 1
    return (
        staged.withColumn("split_rank", inside)
        .join(begins, [*within, *splits])
        .withColumn(name, (F.col("split_begin") + F.col("split_rank")).cast("long"))
        .drop("split_begin", "split_rank")
    )


def loads(rows: DataFrame, shards: int) -> list[int]:
    """Rows in each shard: one number a shard."""
    found = dict(rows.groupBy("shard").agg(F.count(F.lit(1))).collect())
    return [int(found.get(s, 0)) for s in range(shards)]


def lookup(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Moves rows (link, link_n, seed, shard; staged) towards their group's strongest shard under ``quotas``."""
    shards = len(quotas)
    for i in range(rounds):
        load = loads(linked, shards)
        free = [max(0, q - n) for q, n in zip(quotas, load, strict=True)]
        votes = stage(linked.groupBy("link", "link_n", "shard").agg(F.count(F.lit(1)).alias("votes")), "votes")
        tie = F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 30))
        strength = F.struct("votes", tie.alias("tie"), "shard")
        open_ = lookup(free, F.col("shard")) > 0
        best = votes.groupBy("link", "link_n").agg(F.max(F.when(open_, strength)).alias("best"), F.max(strength).alias("top"))
        # Members of a stronger shard than the best one with room stay where they are.
        goals = stage(
            votes.join(best, ["link", "link_n"])
            .filter(F.col("best").isNotNull() & (F.col("best.shard") != F.col("shard")))
            .filter(strength < F.col("best"))
            .select("link", "link_n", "shard", F.col("best.shard").alias("goal"), "votes"),
            "goals",
        )
        asked = dict(goals.groupBy("goal").agg(F.sum("votes")).collect())  # one number a shard
        if not asked:
            break
        admitted = [min(1.0, free[s] / asked[s]) if asked.get(s) else 0.0 for s in range(shards)]
        whole = F.col("link_n") <= min(quotas) // 100 + 1
        draw = F.when(whole, chance(F.col("link"), F.lit(i))).otherwise(chance(F.col("seed"), F.lit(i)))
        # A group has a goal row for each shard at most, so these lists are short.
        wants = goals.groupBy("link", "link_n").agg(F.max("goal").alias("goal"), F.collect_set("shard").alias("movers"))
        rows = attach(linked, stage(wants.select("link", F.col("link_n").alias("goal_n"), "goal", "movers"), "wants"), "link", "goal_n")
        moves = F.col("goal").isNotNull() & F.array_contains("movers", F.col("shard")) & (draw < lookup(admitted, F.col("goal")))
        linked = stage(rows.withColumn("shard", F.when(moves, F.col("goal")).otherwise(F.col("shard"))).select(*linked.columns), "labels")
    return linked


def balanced_shards(rows: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (doc_id, link, other columns) with shard and slot; counts of rows differ by one at most.

    Null doc_ids and repeated rows are rows like any other; rows with a null link have no links; an empty table
    gives none. The names seed, link_n, linked, over, band, part_no and their like are the operator's own.
    """
    columns = [c for c in rows.columns if c != "link"]
    rows = stage(rows.withColumn("seed", F.xxhash64(*rows.columns)), "shard-rows")
    n = total(rows)
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    groups = stage(rows.filter("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("link_n")).filter("link_n > 1"), "links")
    known = stage(attach(rows, groups, "link", "link_n").withColumn("shard", F.pmod("seed", F.lit(shards)).cast("int")), "start")
    linked = propagate(stage(known.filter("link_n is not null"), "labels"), quotas, rounds)
    # Groups stay together in a run; one larger than a run is spread over runs of its own by its rows' seeds.
    run = min(RUN[1], max(RUN[0], n // 2000))
    runs = max(1, n // run)
    band = F.pmod(F.xxhash64("link"), F.lit(runs)).cast("int")
    part = F.pmod(F.col("seed"), F.greatest(F.lit(1), F.col("link_n") / run).cast("long")).cast("int")
    order, splits = ["link", "seed", "doc_id"], ["over", "band", "part_no"]
    bands = linked.withColumns({"over": F.lit(0), "band": band, "part_no": part})
    placed = stage(ranked(bands, ["shard"], order, splits, "slot"), "placed")
    inside = F.col("slot") < lookup(quotas, F.col("shard"))
    kept = [min(q, m) for q, m in zip(quotas, loads(placed, shards), strict=True)]
    singles = known.filter("link_n is null").withColumns({"over": F.lit(1), "band": F.pmod("seed", F.lit(runs)).cast("int"), "part_no": F.lit(0)})
    spare = placed.filter(~inside).drop("slot", "shard").unionByName(singles.drop("shard"))
    pooled = ranked(spare.withColumn("pool", F.lit(0)), ["pool"], order, splits, "place")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        room = quotas[s] - kept[s]
        here = (F.col("place") >= begin) & (F.col("place") < begin + room)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("place") - begin + kept[s]).otherwise(slot)
        begin += room
    filled = pooled.select(*columns, shard.alias("shard"), slot.alias("slot"))
    return placed.filter(inside).select(*columns, "shard", "slot").unionByName(filled)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shard under the law of equal row counts.

    Equal texts are linked. A null text is empty, with a size of 1; other columns are ignored.
    """
    found = balanced_shards(by_text(docs), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

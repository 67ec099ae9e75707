"""Prefix trie of conversations, screened by a count-min sketch.

Every prefix of a conversation has a digest. A sketch that tasks fill for themselves and that is merged block by block
counts the digests; its estimate is never too low, so an estimate of one proves that no other conversation has the
prefix. Below the first such prefix a conversation is alone: its nodes are emitted where the rows are. Only prefixes
that may be shared are shuffled and grouped exactly. What a node needs to know of its subtree is the sum of what each
member knows of its own path, so no node meets its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.shared import attach, mix, stage, total

#: Turns at most that a conversation takes over, and conversations that share a first one.
HEAD, FAMILY = 5, 100
#: Rows of the sketch; counters in each, between these bounds, four for each prefix; counters in a block of the merge.
ROWS, LEAST, MOST, COUNTERS = 2, 1 << 14, 1 << 24, 1 << 16
#: Turns of a conversation that a window holds, and conversation ids that a piece of a list spans.
SPLIT, IDS = 4096, 65536

_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_WORDS = ["m0", "m1", "m2", "m3"]
_ALL = (1 << 32) - 1


def digest(*parts: Column) -> list[Column]:
    """Four numbers of 32 bits, whose sums over positions are the digest of a prefix."""
    text = F.md5(F.concat_ws(":", *parts))
    return [F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(_WORDS)]


def key_of(words: list[Column]) -> Column:
    """16 bytes for four sums, each modulo 2**32."""
    return F.unhex(F.concat(*[F.lpad(F.hex(w.bitwiseAND(F.lit(_ALL))), 8, "0") for w in words]))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), mark and chars of every turn, in order of turn, null first; ties by role and text.

    Rows are dealt by range, so that a conversation of any length is split; counts of the splits give each its first place.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    mark = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars"))
    dealt = stage(rows.repartitionByRange("conv_id", "turn", "mark").withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("part_n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("conv_id", "part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "mark")) - 1
    return dealt.withColumn("own", own).join(begins, ["conv_id", "part"]).select("conv_id", (F.col("begin") + F.col("own")).alias("place"), "mark", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, place, mark, chars), and their lengths (conv_id, length).

    Conversation c takes the first h turns of c - c % 100, h the crc32 of c in decimals modulo 6, then its own after h.
    """
    placed = stage(numbered(turns), "placed-turns")
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = convs.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).alias("h"))
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stage(convs.select("conv_id", "n", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "families")
    heads = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEAD)).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "taken").join(heads, "base").filter("place < taken").select("conv_id", "place", "mark", "chars")
    own = attach(placed, convs.select("conv_id", "n", "h", "taken"), "conv_id", "n").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "mark", "chars")
    return heads.unionByName(own), convs.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, depth, key, parent (its key), chars, tail, length.

    ``tail`` is the code points from the last turn of the prefix to the end of the conversation.
    """
    rows, convs = rebuilt(turns)
    item = rows.select("conv_id", "place", "chars", F.floor(F.col("place") / SPLIT).alias("split"), *digest(F.col("place").cast("string"), F.col("mark")))
    item = stage(item, "turn-digests")
    sums = item.groupBy("conv_id", "split").agg(*[F.sum(c).alias(f"all_{c}") for c in (*_WORDS, "chars")])
    each = Window.partitionBy("conv_id").orderBy("split")
    before, after = each.rowsBetween(Window.unboundedPreceding, -1), each.rowsBetween(1, Window.unboundedFollowing)
    sums = sums.select(
        "conv_id",
        "split",
        *[F.coalesce(F.sum(F.col(f"all_{w}").bitwiseAND(F.lit(_ALL))).over(before), F.lit(0)).alias(f"begin_{w}") for w in _WORDS],
        F.coalesce(F.sum("all_chars").over(after), F.lit(0)).alias("rest"),
    )
    inside = Window.partitionBy("conv_id", "split").orderBy("place")
    upto, onwards = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    summed = item.select("*", *[F.sum(w).over(upto).alias(f"sum_{w}") for w in _WORDS], F.sum("chars").over(onwards).alias("own_tail"))
    summed = summed.join(sums, ["conv_id", "split"])
    own = [F.col(f"begin_{w}") + F.col(f"sum_{w}") for w in _WORDS]
    nodes = summed.select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        key_of(own).alias("key"),
        key_of([c - F.col(w) for c, w in zip(own, _WORDS, strict=True)]).alias("parent"),
        "chars",
        (F.col("own_tail") + F.col("rest")).alias("tail"),
    )
    wholes = nodes.filter("depth = 1").select("conv_id", "tail")
    roots = convs.join(wholes, "conv_id", "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(bytes(16)).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), F.coalesce("tail", F.lit(0)).alias("tail")
    )
    sized = convs.select("conv_id", "length", F.greatest("length", F.lit(1)).alias("length_n"))
    return attach(nodes.unionByName(roots), stage(sized, "lengths"), "conv_id", "length_n").drop("length_n")


# The sketch.


def slots(keys: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The counter of each key in each row of the sketch; null keys have none."""
    words = np.frombuffer(b"".join(keys.drop_null().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    for seed in _SEEDS[:ROWS]:
        yield (mix(words[:, 0] * seed + mix(words[:, 1] ^ seed)) % np.uint64(width)).astype(np.int64)


SKETCH = "row int, block int, task int, once binary, twice binary"


def sketch(keys: DataFrame, width: int) -> DataFrame:
    """Counters of one column of keys, which go to two: for each task and block bitmaps of those over 0 and over 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            for row, at in enumerate(slots(batch.column(0), width)):
                found, n = np.unique(at, return_counts=True)
                counts[row, found] = np.minimum(2, counts[row, found] + np.minimum(n, 2))
        task = TaskContext.get().partitionId()
        for row in range(ROWS):
            for begin in range(0, width, COUNTERS):
                part = counts[row, begin : begin + COUNTERS]
                if part.any():
                    columns = [[row], [begin // COUNTERS], [task], [np.packbits(part > 0).tobytes()], [np.packbits(part > 1).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in SKETCH.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        once = twice = None
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        first = table.slice(0, 1)
        for i, x in ((3, once), (4, twice)):
            first = first.set_column(i, table.field(i), pa.array([x.tobytes()], pa.binary()))
        return first

    parts = keys.mapInArrow(run, SKETCH)
    parts = parts.withColumn("some", F.col("task") % 64).groupBy("row", "block", "some").applyInArrow(lambda t: add(t.drop_columns(["some"])), SKETCH)
    return parts.groupBy("row", "block").applyInArrow(add, SKETCH)


def screened(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``alone`` and ``parent_alone``: whether the sketch proves that one row has the key, one the parent's.

    The merged sketch, ``ROWS`` bitmaps of ``width`` bits at most, goes through the driver: its size is bounded by ``MOST``.
    """
    several = np.zeros((ROWS, width // 8), np.uint8)
    for part in sketch(rows.filter("depth > 0").select("key"), width).select("row", "block", "twice").toLocalIterator():
        begin = part["block"] * COUNTERS // 8
        bits = np.frombuffer(part["twice"], np.uint8)
        several[part["row"], begin : begin + len(bits)] = bits
    sent = rows.sparkSession.sparkContext.broadcast(several)
    names, kinds = rows.columns, rows.schema

    def alone(keys: pa.Array) -> pa.Array:
        known = np.asarray(keys.is_valid())
        one = np.zeros(int(known.sum()), bool)
        for bits, at in zip(sent.value, slots(keys, width), strict=True):
            one |= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
        found = np.zeros(len(keys), bool)
        found[known] = one
        # The root is everyone's.
        return pa.array(found & ~np.asarray(pc.equal(keys, bytes(16)).fill_null(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns, alone(batch.column(names.index("key"))), alone(batch.column(names.index("parent")))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "alone", "parent_alone"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return rows.mapInArrow(run, f"{schema}, alone boolean, parent_alone boolean")


# The trie.


def ends_of(members: DataFrame) -> DataFrame:
    """key and ends_sha256: of each key the hash of its conv_ids in order, joined by commas.

    Pieces of the list are joined where they lie; a task then reads a key's pieces one after the other and holds one.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = members.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


_NONE = hashlib.sha256().hexdigest()


def trie(turns: DataFrame, width_of: Callable[[int], int] | None = None) -> DataFrame:
    """A row for each node of the prefix trie of rebuilt conversations (conv_id, turn, role, text).

    Null role and text are empty strings. Rows without conv_id belong to no conversation and are left out. Turns with
    equal numbers are in the order of md5 of role and text, repeated rows are turns of their own. Other columns
    are ignored. An empty table gives no node, not even a root. Prefixes count as equal by digests of 128 bits.
    """
    rows = stage(paths(turns), "paths")
    width_of = width_of or (lambda n: min(MOST, max(LEAST, 1 << (4 * n - 1).bit_length())))
    rows = stage(screened(rows, width_of(max(1, total(rows)))), "screened-paths")
    own_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NONE))
    single = rows.filter("alone").select(
        "conv_id",
        "depth",
        "parent",
        "parent_alone",
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        own_end.alias("ends_sha256"),
    )
    tails = single.filter("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    shared = rows.filter("not alone").drop("alone", "parent_alone")
    owners = shared.groupBy("key").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    owners = stage(owners, "prefix-owners")
    known = stage(attach(shared, owners, "key", "n"), "shared-paths")
    # The prefixes that a conversation is not the smallest member of come first on its path.
    mine = F.col("owner") == F.col("conv_id")
    begins = known.groupBy("conv_id").agg(
        F.count(F.when(~mine, 1)).alias("begin"),
        F.min(F.when(~mine, F.col("tail") - F.col("chars"))).alias("begin_tail"),
        F.max((F.col("depth") == F.col("length")) & ~(mine & (F.col("longest") == F.col("length")))).alias("no_leaf"),
        F.count(F.lit(1)).alias("path_n"),
    )
    member = stage(attach(known, stage(begins, "path-begins"), "conv_id", "path_n"), "members")
    nodes = member.groupBy("key").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count(F.when((F.col("length") > F.col("depth")) & (F.col("begin") <= F.col("depth") + 1), 1)).alias("n_children"),
        F.count(F.when(~F.col("no_leaf"), 1)).alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("begin"), F.col("tail") - F.col("begin_tail")).otherwise(0)).alias("saved_tokens"),
    )
    ends = ends_of(member.filter("depth = length").select("key", "conv_id"))
    nodes = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).drop("key")
    loose = nodes.unionByName(single.filter("not parent_alone").drop("parent_alone"))
    above = owners.select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"), "n")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # A parent that was not grouped is proven to have one member, the node's own.
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return attach(loose, above, "parent", "n").withColumn("parent_conv_id", parent).select(columns).unionByName(tails.select(columns))

"""Address-to-network lookup in disjoint intervals.

Networks are CIDR blocks, one inside the other. A table of blocks is flattened once: into the places where the
innermost block changes, each with what holds from there on. A lookup then sorts the distinct addresses in among
these places, range by range, and every address takes the last place before it: one look per address, no range
predicate and no nested loop, and no range of addresses is too crowded for a task, as they are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.ip import V4_DIGITS, V6_DIGITS, address_hex, prefix_of
from visitlens.operators.skew import spread_join
from visitlens.streaming.scratch import staged

# Prefixes shorter than these cover many places; for them both sides of the flattening are spread by salts.
SHORT_PREFIX = {4: 16, 6: 32}
PREFIX_SALTS = 16
KEYS = ("family", "bits", "prefix")
# Columns of a flattened table: the first address from which ``holds`` (attributes, or null) is true.
PLACES = ("family", "at", "holds")
# The highest digit with the same first 1, 2 or 3 bits.
HIGHEST = {1: ("08", "7f"), 2: ("048c", "37bf"), 3: ("02468ace", "13579bdf")}


def _family(digits: Column) -> Column:
    return F.when(F.length(digits) == V4_DIGITS, 4).otherwise(6)


def _short() -> Column:
    return F.col("bits") < F.when(F.col("family") == 4, SHORT_PREFIX[4]).otherwise(SHORT_PREFIX[6])


def _digits() -> Column:
    return F.when(F.col("family") == 4, V4_DIGITS).otherwise(V6_DIGITS)


def networks(df: DataFrame, cidr: str = "network") -> DataFrame:
    """Replaces a CIDR column by its key columns; rows that are no CIDR block are dropped."""
    return (
        df.withColumn("_hex", address_hex(F.substring_index(F.col(cidr), "/", 1)))
        .withColumn("bits", F.substring_index(F.col(cidr), "/", -1).try_cast("int"))
        .withColumn("family", _family("_hex"))
        .where("_hex is not null and bits between 0 and if(family = 4, 32, 128)")
        .withColumn("prefix", prefix_of(F.col("_hex"), F.col("bits")))
        .drop("_hex", cidr)
    )


def address_after(prefix: Column, bits: Column, digits: Column) -> Column:
    """The first address behind a block; null behind the last one."""
    whole = F.floor(bits / 4).cast("int")
    last = F.substr(prefix, whole + 1, F.lit(1))
    high = F.lit("")
    for n, (lowest, highest) in HIGHEST.items():
        high = F.when(bits % 4 == n, F.translate(last, lowest, highest)).otherwise(high)
    end = F.concat(F.substr(prefix, F.lit(1), whole), high)
    # One more: the trailing f become 0, the digit before them the next.
    head = F.rtrim(end, F.lit("f"))
    up = F.translate(F.right(head, F.lit(1)), "0123456789abcde", "123456789abcdef")
    return F.when(head != "", F.rpad(F.concat(F.left(head, F.length(head) - 1), up), digits, F.lit("0")))


def innermost(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``points`` (family, at) with the attributes of the longest block that holds each, as ``holds``.

    A point is tried once per prefix length that occurs in the table; at most 33 + 129 lengths are broadcast.
    """
    lengths = blocks.select("family", "bits").distinct()
    tries = (
        points.join(F.broadcast(lengths), "family")
        .withColumn("_salt", F.when(_short(), F.pmod(F.xxhash64("at"), F.lit(PREFIX_SALTS)).cast("int")).otherwise(0))
        .withColumn("prefix", prefix_of(F.col("at"), F.col("bits")))
    )
    every_salt = F.sequence(F.lit(0), F.lit(PREFIX_SALTS - 1))
    copies = blocks.withColumn("_salt", F.explode(F.when(_short(), every_salt).otherwise(F.array(F.lit(0)))))
    hits = tries.join(copies, [*KEYS, "_salt"]).groupBy("family", "at").agg(F.max_by("holds", "bits").alias("holds"))
    return points.join(hits, ["family", "at"], "left")


def flatten(table: DataFrame) -> DataFrame:
    """The places of a table from :func:`networks`, each with the attributes of the innermost block from there on.

    The innermost block changes where a block begins, to the longest that begins there, and behind the end of a block,
    to what holds the block, if another doesn't begin there.
    """
    attributes = F.struct(*[c for c in table.columns if c not in KEYS])
    blocks = staged(table.select(*KEYS, attributes.alias("holds")), "blocks")
    at = F.rpad("prefix", _digits(), F.lit("0")).alias("at")
    begins = staged(blocks.groupBy("family", at).agg(F.max_by("holds", "bits").alias("holds")), "begins")
    ends = blocks.select("family", address_after(F.col("prefix"), F.col("bits"), _digits()).alias("at")).where("at is not null")
    zeros = table.sparkSession.createDataFrame([(4, "0" * V4_DIGITS), (6, "0" * V6_DIGITS)], "family int, at string")
    ends = ends.unionByName(zeros).distinct().join(begins, ["family", "at"], "left_anti")
    return begins.unionByName(innermost(ends, blocks)).select(*PLACES)


def prepared(table: DataFrame, name: str = "networks") -> DataFrame:
    """A flattened table, stored in order, for lookups that come again and again, such as those of a stream."""
    return table if set(table.columns) == set(PLACES) else staged(flatten(table).sort("family", "at"), name)


def located(addresses: DataFrame, tables: dict[str, DataFrame], key: str = "client_ip") -> DataFrame:
    """``addresses``, one row each, with one struct column per network table, null where no block covers the address.

    Tables come from :func:`networks` or, better, from :func:`prepared`. All of them share one pass.
    """
    flat = {name: prepared(table) for name, table in tables.items()}
    digits = address_hex(F.col(key))
    # Text that is no address comes before all places.
    found = addresses.select(
        F.when(digits.isNull(), 0).otherwise(_family(digits)).alias("_family"),
        F.coalesce(digits, F.lit("")).alias("_at"),
        F.struct(*addresses.columns).alias("_row"),
    )
    # A wrapper tells a gap from a row of another table.
    places = [t.select(F.col("family").alias("_family"), F.col("at").alias("_at"), F.struct("holds").alias(f"_{name}")) for name, t in flat.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [found, *places])
    dealt = staged(rows.repartitionByRange("_family", "_at").withColumn("_part", F.spark_partition_id()), "addresses")
    # What holds at the begin of a range is what held last in those before it: one row for each range.
    last = [F.max_by(f"_{n}", F.struct("_family", "_at")).alias(f"_{n}") for n in flat]
    known = [dealt.where(F.col(f"_{n}").isNotNull()).groupBy("_part").agg(agg) for n, agg in zip(flat, last, strict=True)]
    tails = reduce(lambda a, b: a.join(b, "_part", "full"), known)
    parts = dealt.select("_part").distinct().join(tails, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}_before") for n in flat])
    inside = Window.partitionBy("_part").orderBy("_family", "_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    holds = dealt.select("_part", "_row", *[F.last(f"_{n}", ignorenulls=True).over(inside).alias(f"_{n}") for n in flat])
    holds = holds.where("_row is not null").join(F.broadcast(carried), "_part")
    return holds.select("_row.*", *[F.coalesce(f"_{n}", f"_{n}_before").getField("holds").alias(n) for n in flat])


def attach(events: DataFrame, tables: dict[str, DataFrame], key: str = "client_ip") -> DataFrame:
    """Adds one struct column per network table, NULL where no block covers the address.

    One pass finds the distinct addresses, whose attributes are then joined back to the events.
    """
    per_ip = events.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return spread_join(events, located(per_ip, tables, key), key, "_rows", "left")

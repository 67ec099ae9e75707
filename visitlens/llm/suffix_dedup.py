"""Removal of long repeated byte strings with suffix arrays.

Every window of ``WIDTH`` bytes has an anchor, the 32-byte string in it with the smallest hash, so equal windows
have equal anchors. Neighbouring windows with one anchor form a context. Contexts whose anchor occurs once
repeat nothing. The others are brought together by anchor in shards; a shard's contexts are laid end to end and
sorted by induction, permuted common prefixes tell which windows are equal, and a window repeats if the contexts
that hold it occur twice or more. Equal contexts are laid out once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.exact_dedup import owners_for, suspects
from visitlens.llm.shared import attach, may_contain, mix, release, releasing, row_key, stage, total, with_maybe

#: Bytes of a repeated string, and of an anchor.
WIDTH, ANCHOR = 200, 32
#: Bytes of text that a task looks at together.
PIECE = 1 << 18
#: Bytes of contexts in a shard; an anchor with more contexts than ``CROWD`` is split by window instead.
SHARD, CROWD = 1 << 20, 4096
#: Texts that a task rewrites at a time.
SLICE = 256
#: Symbols up to which a reduced string is sorted by induction again; beyond, by doubling of ranks.
WIDE = 1024

BASE = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as far as a text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (BASE, inverse))
        return self.up[:n], self.down[:n]


def values_of() -> np.ndarray:
    """A random number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Hashes:
    """Hashes of any stretch of a row of numbers."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from minima within blocks."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, bounds: np.ndarray, powers: Powers, values: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (text i ends at bounds[i]): begin and end of each context, its anchor's hash and its own."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none
    gram = min(ANCHOR, width // 2)
    hashes = Hashes(values[data], powers)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    # The order of anchors is by the upper bits, then by place, so a window's anchor depends on its bytes alone.
    low = np.uint64((1 << 24) - 1)
    place = (sliding_least((grams & ~low) | at.astype(np.uint64), width - gram + 1) & low).astype(np.int32)
    del at
    starts = np.arange(n - width + 1, dtype=np.int32)
    text = np.repeat(np.arange(len(bounds), dtype=np.int32), np.diff(bounds, prepend=0))[: len(starts)]
    inside = starts + width <= bounds[text]
    starts, place, text = starts[inside], place[inside], text[inside]
    del inside
    if not len(starts):
        return none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    begin, end = starts[first].astype(np.int64), starts[np.append(first[1:], len(starts)) - 1].astype(np.int64) + width
    return begin, end, grams[place[first]].view(np.int64), hashes.of(begin, end).view(np.int64)


ANCHORS = "row_key long, begins array<int>, ends array<int>, anchors array<bigint>, hashes array<bigint>"


def anchored(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each text, or stretch of a long one: its contexts."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, values = Powers(), values_of()
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
            bounds = np.cumsum([len(x) for _, _, x in held])
            begin, end, anchor, own = contexts(data, bounds, powers, values, width)
            text = np.searchsorted(bounds, begin, side="right")
            # Places within the whole text.
            move = np.array([offset for _, offset, _ in held]) - np.concatenate([[0], bounds[:-1]])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(held)))]).astype(np.int32)
            lists = [((begin + move[text]).astype(np.int32), pa.int32()), ((end + move[text]).astype(np.int32), pa.int32()), (anchor, pa.int64()), (own, pa.int64())]
            columns = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, k)) for x, k in lists]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held], pa.int64()), *columns], ["row_key", "begins", "ends", "anchors", "hashes"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                for offset in range(0, max(1, len(data) - width + 1), PIECE):
                    held.append((key, offset, data[offset : offset + PIECE + width - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.select(row_key(), "text").filter(F.octet_length("text") >= width).mapInArrow(run, ANCHORS)


# The suffix array of a shard.


def types_of(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    n = len(s)
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    decided = at < n
    small[:-1][decided] = step[at[decided]] > 0
    return small


def induced(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from leftmost smaller ones in order: larger types bucket by bucket upwards, smaller ones downwards.

    Within a bucket, suffixes that induce into the same bucket go round by round; all else is one step of arrays.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    by = np.argsort(s[lms], kind="stable")
    lms = lms[by]
    seeds = np.split(lms, np.cumsum(np.bincount(s[lms], minlength=len(sizes)))[:-1])
    symbols = np.flatnonzero(sizes)
    result = np.empty(len(s), np.int64)

    def spread(found: np.ndarray, put: Callable) -> None:
        order = np.argsort(s[found], kind="stable")
        found = found[order]
        marks = s[found]
        cuts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        for part in np.split(found, cuts):
            if len(part):
                put(int(s[part[0]]), part)

    larger: list[list[np.ndarray]] = [[] for _ in sizes]
    n_larger = np.zeros(len(sizes), np.int64)
    for c in symbols.tolist():
        waiting, done, after = larger[c], [], []
        while waiting:
            now = np.concatenate(waiting)
            done.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            same = s[before] == c
            after.append(before[~same])
            waiting = [before[same]] if same.any() else []
        mine = np.concatenate(done) if done else np.empty(0, np.int64)
        result[begins[c] : begins[c] + len(mine)] = mine
        n_larger[c] = len(mine)
        before = seeds[c][seeds[c] > 0] - 1
        after.append(before[~small[before]])
        spread(np.concatenate(after), lambda symbol, part: larger[symbol].append(part))
    lower: list[list[np.ndarray]] = [[] for _ in sizes]
    for c in symbols[::-1].tolist():
        waiting, done, after = lower[c], [], []
        while waiting:
            now = np.concatenate(waiting)
            done.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            same = s[before] == c
            after.append(before[~same])
            waiting = [before[same]] if same.any() else []
        mine = np.concatenate(done) if done else np.empty(0, np.int64)
        if len(mine) < sizes[c] - n_larger[c]:  # the end of the text, which nothing induces
            mine = np.append(mine, len(s) - 1)
        result[begins[c] + n_larger[c] : ends[c]] = mine[::-1]
        own = result[begins[c] : begins[c] + n_larger[c]][::-1]
        before = own[own > 0] - 1
        after.append(before[small[before]])
        spread(np.concatenate(after), lambda symbol, part: lower[symbol].append(part))
    return result


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over many symbols: ranks of ever longer prefixes, where not yet distinct."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def regroup(places: np.ndarray, sorted_: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks are places of the first of a group; returns the members of groups of several, in order."""
        first = np.flatnonzero(new)
        rank[sorted_] = places[np.repeat(first, np.diff(np.append(first, len(new))))]
        alone = new & np.append(new[1:], True)
        return ~alone

    several = regroup(np.arange(n), order, np.concatenate([[True], np.diff(names[order]) != 0]))
    places, members, reach = np.flatnonzero(several), order[several], 1
    while len(members):
        ahead = rank[np.minimum(members + reach, n)]
        own = rank[members]
        by = np.lexsort((ahead, own))
        members, own, ahead = members[by], own[by], ahead[by]
        order[places] = members
        several = regroup(places, members, np.concatenate([[True], (np.diff(own) != 0) | (np.diff(ahead) != 0)]))
        places, members, reach = places[several], members[several], 2 * reach
    return order


def suffix_array(s: np.ndarray, hashes: Hashes | None = None) -> np.ndarray:
    """Suffixes of ``s`` in order; its last symbol occurs once and is the smallest."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    small = types_of(s)
    sizes = np.bincount(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induced(s, small, sizes, lms)
    rough = induced(s, small, sizes, lms)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = rough[mark[rough]]
    # Equal substrings between leftmost smaller places get equal names.
    hashes = hashes or Hashes(mix((s + 1).astype(np.uint64) * BASE), Powers())
    until = np.empty(n, np.int64)
    until[lms] = np.append(lms[1:], n - 1) + 1
    own = hashes.of(ordered, until[ordered])
    length = until[ordered] - ordered
    changed = np.concatenate([[False], (own[1:] != own[:-1]) | (length[1:] != length[:-1])])
    name = np.empty(n, np.int64)
    name[ordered] = np.cumsum(changed)
    names = name[lms]
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        final = ordered
    else:
        final = lms[suffix_array(names) if kinds <= WIDE else doubled(names)]
    return induced(s, small, sizes, final)


def common_prefixes(order: np.ndarray, marks: np.ndarray, hashes: Hashes, most: int, least: int = 0) -> np.ndarray:
    """For each place, the common prefix with the suffix before it in order, ``most`` at most; 0 if under ``least``.

    It is worked out by bisection where the bytes before differ; one place further on it is one less.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    known = before >= 0
    reducible = known & (place > 0) & (before > 0)
    reducible[reducible] = marks[place[reducible] - 1] == marks[before[reducible] - 1]
    own = np.flatnonzero(~reducible)
    if least:
        own = own[known[own] & (np.maximum(own, before[own]) + least <= n)]
        own = own[hashes.of(own, own + least) == hashes.of(before[own], before[own] + least)]
    a, b = own, np.maximum(before[own], 0)
    low, high = np.full(len(own), least), np.where(known[own], np.minimum(most, n - np.maximum(a, b)), 0)
    while (low < high).any():
        middle = low + high + 1 >> 1
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    prefix = np.zeros(n, np.int64)
    prefix[own] = low
    last = np.maximum.accumulate(np.where(reducible, -1, place))
    found = np.maximum(prefix[last] - (place - last), 0)
    return np.where(found >= least, found, 0)


def repeated_windows(texts: list[bytes], weights: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the places of windows that occur twice or more, a text counting as often as its weight."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    data[ends] = 1
    s = np.append(data, 0)
    # Separators sort alike but count as different, so no common prefix runs across one.
    values = np.append(values_of()[np.maximum(data - 2, 0)], np.uint64(1))
    values[ends] = mix(np.arange(1, len(ends) + 1, dtype=np.uint64) + np.uint64(1 << 40))
    hashes = Hashes(values, Powers())
    order = suffix_array(s, hashes)
    prefix = common_prefixes(order, values, hashes, 4 * width, width)
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    weight = np.zeros(len(s), np.int64)
    at = np.arange(len(data))
    whole = at + width <= ends[text]
    weight[:-1][whole] = weights[text[whole]]
    new = prefix[order] < width
    first = np.flatnonzero(new)
    sums = np.add.reduceat(weight[order], first)
    repeats = np.zeros(len(s), bool)
    repeats[order] = np.repeat(sums, np.diff(np.append(first, len(s)))) >= 2
    repeats &= weight > 0
    return [np.flatnonzero(repeats[b:e]) for b, e in zip(begins, ends, strict=True)]


def runs_of(places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches that windows at ``places`` (sorted) cover."""
    if not len(places):
        return places, places
    cuts = np.flatnonzero(np.diff(places) > width)
    return places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)] + width


CUTS = "hash long, anchor long, n long, window long, place int, bytes binary"


def cut_out(texts: DataFrame, width: int) -> DataFrame:
    """The bytes of wanted contexts; of those with a crowded anchor, a hash for each window instead."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, values = Powers(), values_of()
        names = [x.split()[0] for x in CUTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode()
                for w in wanted.as_py():
                    own = data[w["begin"] : w["end"]]
                    if not w["crowded"]:
                        rows.append((w["hash"], w["anchor"], w["n"], None, None, own))
                        continue
                    at = np.arange(len(own) - width + 1)
                    found = Hashes(values[np.frombuffer(own, np.uint8)], powers).of(at, at + width).view(np.int64).tolist()
                    rows.extend((w["hash"], w["anchor"], w["n"], x, i, None) for i, x in enumerate(found))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(run, CUTS)


FOUND = "hash long, begins array<int>, ends array<int>"


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """row_key and the stretches (begins, ends: in bytes, may overlap) of each text that repeated strings cover."""
    found = stage(anchored(docs, width), "anchors")
    flat = found.select("row_key", F.explode(F.arrays_zip("begins", "ends", "anchors", "hashes")).alias("c")).select(
        "row_key", F.col("c.begins").alias("begin"), F.col("c.ends").alias("end"), F.col("c.anchors").alias("anchor"), F.col("c.hashes").alias("hash")
    )
    owners = owners_for(total(found, F.size("anchors")))
    shared = stage(suspects(found.select(F.explode("anchors")), owners), "shared-anchors")
    places = stage(may_contain(flat, "anchor", shared, "fingerprint"), "places")
    kinds = places.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "begin", "end")).alias("one"))
    kinds = stage(kinds, "contexts")
    crowds = kinds.groupBy("anchor").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).filter("times > 1")
    wanted = attach(kinds, stage(crowds, "crowds"), "anchor", "contexts").filter("times is not null")
    wanted = stage(wanted.select("anchor", "hash", "n", "one.*", "least", (F.col("contexts") > CROWD).alias("crowded")), "wanted")
    # Contexts that occur twice or more repeat as a whole; where that is all that an anchor has, there is nothing to sort.
    whole_ones = wanted.filter("least > 1").select("hash", F.array(F.lit(0)).alias("begins"), F.array(F.col("end") - F.col("begin")).alias("ends"))
    wanted = wanted.filter("least = 1")
    by_text = wanted.groupBy("row_key").agg(F.collect_list(F.struct("begin", "end", "anchor", "hash", "n", "crowded")).alias("wanted"))
    # Rows that repeat doc_id and text are one here: their contexts were counted above.
    texts = may_contain(docs.select(row_key().alias("row_key"), "text"), "row_key", wanted, "row_key").dropDuplicates(["row_key"])
    cuts = stage(cut_out(texts.join(by_text, "row_key").select("text", "wanted"), width), "cuts")
    whole = cuts.filter("bytes is not null")
    shards = max(1, total(whole, F.octet_length("bytes")) // SHARD)

    def run(table: pa.Table) -> pa.Table:
        texts_ = [x.as_py() for x in table.column("bytes")]
        windows = repeated_windows(texts_, table.column("n").to_numpy(), width)
        spans = [runs_of(w, width) for w in windows]
        kept = [i for i, (b, _) in enumerate(spans) if len(b)]
        lists = [pa.array([spans[i][k].astype(np.int32) for i in kept], pa.list_(pa.int32())) for k in (0, 1)]
        release()
        return pa.table([table.column("hash").combine_chunks().take(pa.array(kept, pa.int64())), *lists], names=["hash", "begins", "ends"])

    sorted_ = whole.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "hash", "n", "bytes").groupBy("shard")
    answers = sorted_.applyInArrow(run, FOUND)
    windows = cuts.filter("window is not null")
    often = windows.groupBy("window").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("holders")).filter("times > 1")
    split = attach(windows.select("hash", "window", "place"), stage(often, "windows"), "window", "holders").filter("times is not null")
    split = split.groupBy("hash").agg(F.sort_array(F.collect_list("place")).alias("begins"))
    split = split.select("hash", "begins", F.transform("begins", lambda p: p + width).alias("ends"))
    answers = stage(answers.unionByName(split).unionByName(whole_ones), "repeats")
    sizes = kinds.groupBy("hash").agg(F.sum("n").alias("n"))
    sized = stage(answers.join(sizes, "hash"), "sized-repeats")
    hits = attach(places.select("row_key", "begin", "hash"), sized, "hash", "n").filter("n is not null")
    moved = hits.select("row_key", *[F.transform(c, lambda x: x + F.col("begin")).alias(c) for c in ("begins", "ends")])
    return moved.groupBy("row_key").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))


def kept_bytes(data: bytes, begins: list[int], ends: list[int]) -> tuple[bytes, int]:
    """What is left of a text, and the number of stretches that go."""
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what stays when repeated strings are removed, as bytes.

    A byte goes if a string of ``width`` bytes that covers it also starts elsewhere, in the same text or another.
    A null text is empty. Rows that repeat a doc_id are texts of their own; other columns are ignored; an empty
    table gives none. What is left may cut a character in two, so it is binary.
    """
    spans = stage(repeats(docs, width), "spans")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"))
    marked = with_maybe(rows, "row_key", spans, "row_key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = []
            for text, begins, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode()
                kept, n = kept_bytes(data, begins.as_py() or [], ends.as_py() or [])
                rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    changed = marked.filter("maybe").join(spans, "row_key", "left").select("doc_id", "text", "begins", "ends").mapInArrow(run, f"doc_id {kind}, {RESULT}")
    same = marked.filter("not maybe").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.col("text").cast("binary").alias("kept"),
    )
    return same.unionByName(changed)

"""Substring dedup over words by relative Lempel-Ziv parsing.

Every window of ``WIDTH`` words has an anchor, the run of a few words in it with the smallest hash, so equal windows
have equal anchors, and neighbouring windows with one anchor form a context. Of equal contexts the first stands for
all: the others are repeats as a whole. The first contexts whose anchor others have as well are laid out as reference
blocks: all contexts of an anchor go to the block of the place where the anchor occurs first, so a passage and what
was copied from it meet in one block, as long stretches. A block is indexed by a suffix array, and each stretch in it
is factored greedily against all that comes earlier in the corpus: a factor is the longest earlier match. Windows
inside a factor are repeats; those that cross the boundaries of factors are checked one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.exact_dedup import owners_for, suspects
from visitlens.llm.shared import attach, may_contain, mix, release, releasing, row_key, stage, total, with_maybe
from visitlens.llm.suffix_dedup import Hashes, Powers, sliding_least

#: Words of a repeated window, and of an anchor; longer anchors deal out again what is too much for one block, and an
#: anchor as long as the window leaves one context of each kind.
WIDTH, ANCHORS = 20, (8, 14, 20)
#: Words that a task looks at together; windows of a block, and of the contexts that share a home.
PIECE, BLOCK, HOME = 1 << 17, 1 << 16, 1 << 16
#: Words of a text over which anchors that occur there first have one home.
STRETCH = 512
#: Texts that a task rewrites at a time.
SLICE = 256


def words_of(content: str | bytes | None) -> np.ndarray:
    """Hashes of the words of a text, or the hashes that are there already."""
    if isinstance(content, bytes):
        return np.frombuffer(content, np.uint64)
    words = (content or "").encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def contexts(words: np.ndarray, ends: np.ndarray, width: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (text i ends at ends[i]): begin and end of each context, its anchor's hash and its own."""
    if len(words) < width:
        none = np.empty(0, np.int64)
        return none, none, none, none
    hashes = Hashes(mix(words), powers)
    at = np.arange(len(words) - gram + 1)
    grams = hashes.of(at, at + gram)
    # The order of anchors is by the upper bits, then by place, so a window's anchor depends on its words alone.
    low = np.uint64((1 << 24) - 1)
    place = (sliding_least((grams & ~low) | at.astype(np.uint64), width - gram + 1) & low).astype(np.int64)
    starts = np.arange(len(words) - width + 1)
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + width <= ends[text]
    starts, place, text = starts[inside], place[inside], text[inside]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(starts) else starts
    begin = starts[first]
    end = starts[np.append(first[1:], len(starts)) - 1] + width if len(starts) else begin
    return begin, end, grams[place[first]].view(np.int64), hashes.of(begin, end).view(np.int64)


def anchored(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """A row for each text, or piece of a long one, of (doc_id, row_key, offset, content): its contexts.

    Places count from the begin of the whole text; ``offset`` is that of the content.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, offset int, begins array<int>, ends array<int>, anchors array<bigint>, hashes array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple[pa.RecordBatch, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(w) for _, _, w in held])
            ends = np.cumsum(lengths)
            found = contexts(np.concatenate([w for _, _, w in held]), ends, width, gram, powers)
            text = np.searchsorted(ends, found[0], side="right")
            move = (np.array([at for _, at, _ in held]) - (ends - lengths))[text]
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(held)))]), pa.int32())
            lists = [((found[0] + move).astype(np.int32), pa.int32()), ((found[1] + move).astype(np.int32), pa.int32()), (found[2], pa.int64()), (found[3], pa.int64())]
            keys = pa.Table.from_batches([row for row, _, _ in held]).combine_chunks()
            columns = [keys.column(i).combine_chunks() for i in range(3)] + [pa.ListArray.from_arrays(cuts, pa.array(x, k)) for x, k in lists]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(3)[i].as_py())
                if len(words) < width:
                    continue
                key, offset = batch.slice(i, 1).select([0, 1, 2]), batch.column(2)[i].as_py()
                for begin in range(0, len(words) - width + 1, PIECE):
                    held.append((key, offset + begin, words[begin : begin + PIECE + width - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.select("doc_id", "row_key", "offset", "content").mapInArrow(run, schema)


def cut_out(texts: DataFrame) -> DataFrame:
    """Stretches (doc_id, row_key, begin, block, words) of texts: wanted contexts of one block that meet or overlap.

    So no place of a text is in a block twice.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, begin int, block long, words binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            of, rows = [], []
            for i in range(batch.num_rows):
                words, offset = words_of(batch.column(3)[i].as_py()), batch.column(2)[i].as_py()
                key = batch.column(1)[i].as_py()
                merged: list[list] = []
                for w in sorted(batch.column(4)[i].as_py(), key=lambda w: (w["block"], w["begin"])):
                    if merged and merged[-1][2] == w["block"] and w["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], w["end"])
                    else:
                        merged.append([w["begin"], w["end"], w["block"]])
                of += [i] * len(merged)
                rows += [(key, b, block, words[b - offset : e - offset].tobytes()) for b, e, block in merged]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], [x.split()[0] for x in schema.split(", ")])

    return texts.select("doc_id", "row_key", "offset", "content", "wanted").mapInArrow(run, schema)


# A reference block.


def suffix_order(names: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a text whose last symbol occurs once, by doubling the prefix that ranks stand for."""
    n, reach = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return rank


def earlier_neighbours(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest suffixes in order, on either side, that begin earlier; -1 for none."""
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    order, ranks = order.tolist(), rank.tolist()
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    before, after = [-1] * n, [-1] * n
    # Taken out from the last place to the first, each suffix has only earlier ones beside it.
    for place in range(n - 1, -1, -1):
        r = ranks[place]
        a, b = left[r], right[r]
        if a >= 0:
            before[place] = order[a]
            right[a] = b
        if b >= 0:
            after[place] = order[b]
            left[b] = a
    return np.array(before, np.int64), np.array(after, np.int64)


def common(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of places a and b, ``most`` at most, by bisection; 0 where b is -1."""
    low, high = np.zeros(len(a), np.int64), np.where(b >= 0, most, 0)
    b = np.maximum(b, 0)
    while (low < high).any():
        middle = low + high + 1 >> 1
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def longest_earlier(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, each with an end of its own: length of the longest earlier match at each place, begins, ends."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    words = np.zeros(len(texts) + int(lengths.sum()), np.uint64)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = np.concatenate(texts)
    names = np.empty(len(words), np.int64)
    kinds, names[inside] = np.unique(words[inside], return_inverse=True)
    names[ends] = len(kinds) + np.arange(len(ends))
    rank = suffix_order(names)
    hashes = Hashes(mix(names.astype(np.uint64) + np.uint64(1)), Powers())
    place = np.arange(len(words))
    left_over = np.repeat(ends, lengths + 1) - place
    longest = np.zeros(len(words), np.int64)
    for other in earlier_neighbours(rank):
        most = np.minimum(left_over, len(words) - np.maximum(place, other))
        longest = np.maximum(longest, common(hashes, place, other, most))
    return longest, begins, ends


def factors(longest: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begins of the factors of each text: from each cursor the longest earlier match, or one new word."""
    steps, found = longest.tolist(), []
    for place, end in zip(begins.tolist(), ends.tolist(), strict=True):
        while place < end:
            found.append(place)
            place += steps[place] or 1
        found.append(end)
    return np.array(found, np.int64)


def repeated(texts: list[np.ndarray], width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, in the order given, begins and ends of spans (they may overlap) that occur earlier, in it or before it."""
    longest, begins, ends = longest_earlier(texts)
    cuts = factors(longest, begins, ends)
    long = cuts[longest[cuts] >= width]
    spans = [(long, long + longest[long])]
    # Windows that cross a boundary.
    place = np.arange(len(longest))
    next_cut = cuts[np.minimum(np.searchsorted(cuts, place, side="right"), len(cuts) - 1)]
    crossing = np.flatnonzero((next_cut < place + width) & (longest >= width))
    spans.append((crossing, crossing + width))
    first, last = (np.concatenate(x) for x in zip(*spans, strict=True))
    by = np.argsort(first, kind="stable")
    first, last = first[by], last[by]
    cut = np.searchsorted(first, np.append(begins, len(longest)))
    return [(first[a:b] - begin, last[a:b] - begin) for a, b, begin in zip(cut[:-1], cut[1:], begins, strict=True)]


SPANS = "row_key long, begins array<int>, ends array<int>"


def parsed(blocks: DataFrame, width: int) -> DataFrame:
    """row_key, begins and ends of what repeats in the stretches of each block (see ``cut_out``)."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "row_key", "begin")], null_placement="at_start")
        table = table.take(order)
        begin = table.column("begin").to_numpy()
        spans = repeated([np.frombuffer(w.as_py(), np.uint64) for w in table.column("words")], width)
        kept = [i for i, (b, _) in enumerate(spans) if len(b)]
        release()
        lists = [pa.array([(spans[i][k] + begin[i]).astype(np.int32) for i in kept], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.table([table.column("row_key").take(pa.array(kept, pa.int64())), *lists], names=["row_key", "begins", "ends"])

    return blocks.groupBy("block").applyInArrow(run, SPANS)


# All blocks.


def dealt(texts: DataFrame, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Spans of contexts that an equal one precedes, and stretches of first contexts by block, -1 for crowded homes."""
    found = stage(anchored(texts, width, gram), "contexts")
    flat = found.select("doc_id", "row_key", "offset", F.explode(F.arrays_zip("begins", "ends", "anchors", "hashes")).alias("c"))
    flat = flat.select("doc_id", "row_key", "offset", *[F.col(f"c.{c}s" if c != "hash" else "c.hashes").alias(c) for c in ("begin", "end", "anchor", "hash")])
    anchors = found.select(F.explode("anchors").alias("anchor"))
    shared = stage(suspects(anchors, owners_for(total(found, F.size("anchors")))), "shared-anchors")
    places = stage(may_contain(flat, "anchor", shared, "fingerprint"), "context-places")
    one = F.min(F.struct("doc_id", "row_key", "begin", "end", "offset")).alias("one")
    kinds = stage(places.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), one), "context-kinds")
    first = kinds.filter("n > 1").select("hash", "n", F.col("one.row_key").alias("first_key"), F.col("one.begin").alias("first_begin"))
    later = attach(places.select("row_key", "begin", "end", "hash"), first, "hash", "n").filter("n is not null and (row_key != first_key or begin != first_begin)")
    later = later.groupBy("row_key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    homes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("one").alias("home"))
    home = F.xxhash64("home.row_key", F.floor(F.col("home.begin") / STRETCH))
    homes = stage(homes.filter("contexts > 1").select("anchor", "contexts", home.alias("home")), "anchor-homes")
    wanted = attach(kinds, homes, "anchor", "contexts").filter("home is not null")
    wanted = stage(wanted.select("one.*", "home"), "first-contexts")
    windows = F.sum(F.col("end") - F.col("begin") - (width - 1))
    sizes = stage(wanted.groupBy("home").agg(F.count(F.lit(1)).alias("contexts"), windows.alias("windows")), "home-sizes")
    count = total(sizes.filter(F.col("windows") <= HOME), F.col("windows")) // BLOCK + 1
    block = F.when(F.col("windows") <= HOME, F.pmod(F.xxhash64("home"), F.lit(count))).otherwise(-1)
    wanted = attach(wanted, sizes, "home", "contexts").withColumn("block", block)
    by_text = wanted.groupBy("row_key", "offset").agg(F.collect_list(F.struct("begin", "end", "block")).alias("wanted"))
    by_text = stage(by_text, "wanted")
    # Rows that repeat doc_id and text are one document.
    held = may_contain(texts, "row_key", by_text, "row_key").dropDuplicates(["row_key", "offset"])
    return stage(later, "later-contexts"), stage(cut_out(held.join(by_text, ["row_key", "offset"])), "stretches")


def repeats(docs: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = ANCHORS) -> DataFrame:
    """row_key and the spans (begins, ends: in words, they may overlap) of each text that windows with earlier ones cover.

    Contexts of a home with more words than a block may have are dealt out again by longer anchors. The last anchors are
    whole windows, of which equal ones are one context: there nothing is left that could crowd a home.
    """
    texts = docs.select("doc_id", row_key().alias("row_key"), F.lit(0).alias("offset"), F.col("text").alias("content")).filter("content is not null")
    spans = []
    for gram in grams:
        later, stretches = dealt(texts, width, gram)
        spans += [later, stage(parsed(stretches.filter("block >= 0"), width), "parsed")]
        texts = stretches.filter("block < 0").select("doc_id", "row_key", F.col("begin").alias("offset"), F.col("words").alias("content"))
        if texts.isEmpty():
            break
    all_ = reduce(DataFrame.unionByName, spans)
    return all_.groupBy("row_key").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))


def without_repeats(docs: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = ANCHORS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its words without those of windows that occur earlier.

    Words are runs of characters other than ASCII white space. A window is ``width`` words in a row; it is a repeat if
    its words also start earlier, in a smaller doc_id or earlier in the same text, and all words that a repeat covers
    go. A null doc_id is smaller than any; texts with one doc_id are in a fixed order; rows that repeat doc_id and
    text are one document and get the same answer. A null text has no words; other columns are ignored; an empty
    table gives none.
    """
    spans = stage(repeats(docs, width, grams), "word-spans")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"))
    marked = with_maybe(rows, "row_key", spans, "row_key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = []
            for text, begins, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode().split()
                n = len(words)
                if begins.is_valid:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, begins.as_py(), 1)
                    np.add.at(change, ends.as_py(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    none = F.lit(None).cast("array<int>")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    touched = marked.filter("maybe").join(spans, "row_key", "left").select("doc_id", "text", "begins", "ends")
    others = marked.filter("not maybe").select("doc_id", "text", none.alias("begins"), none.alias("ends"))
    return touched.mapInArrow(run, schema).unionByName(others.mapInArrow(run, schema))

"""Similarity join on word n-grams by T-occurrence search.

Documents whose sets of n-grams overlap by the threshold or more are linked. First, tasks send the n-grams of
their documents, each once, to owners of ranges of the hash space, which answer which of them another document
holds too; a document with too few shared n-grams can have no partner. The rest are brought together by their
rarest n-grams and searched with DivideSkip: of a document's inverted lists the long ones are set aside, the
short ones are merged, and what occurs often enough in them is probed for in the long ones by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.components import components
from visitlens.llm.shared import attach, mix, packed, row_key, stage, total, with_maybe, without, word_hashes

#: Words in an n-gram, and the similarity that links, in hundredths.
N, PERCENT = 5, 75
#: N-grams and documents that a task sends at a time.
CHUNK, CHUNK_DOCS = 1 << 21, 1 << 16
#: Bytes of text for each owner of a hash range, and owners at least, so that small tables use all executors.
OWNED, OWNERS = 8 << 20, 32
#: Documents that are indexed at a time.
BLOCK = 1024
#: Weight of merging against probing when the long lists are chosen.
MU = 0.01
#: Candidates that are probed together.
PROBES = 8


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """The sorted set of hashed n-grams; of fewer words, the whole sequence; of none, nothing."""
    if not len(words):
        return np.empty(0, np.uint64)
    span = min(n, len(words))
    starts = len(words) - span + 1
    found = np.full(starts, span, np.uint64)
    for place in range(span):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + words[place : place + starts])
    return np.unique(found)


def needed(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Overlap with any partner that a set of ``n`` must have."""
    return -(-percent * n // 100)


def linked(inter: np.ndarray, n: int, other: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * inter >= percent * (n + other - inter)


SENT = "key long, chunk long, owner int, tokens binary, leads binary, multi binary, counts binary, doc_ids array<bigint>, row_keys array<bigint>, sizes binary, local binary, lists binary, lengths binary"
REPLY = "chunk long, owner int, ids binary, at binary, multi binary, rarity binary, heads binary, head_at binary, doc_ids array<bigint>, row_keys array<bigint>, sizes binary, local binary, lists binary, lengths binary"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def narrow(gaps: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return full.view("<u8").reshape(-1).astype(np.uint64)


def as_table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split(maxsplit=1) for x in schema.split(", ")]
    return pa.table({f: pa.array([r.get(f) for r in rows], kinds[k]) for f, k in fields})


def sent_rows(chunk: int, keys: list, row_keys: list, sets: list[np.ndarray], owners: int) -> list[dict]:
    """The messages of a chunk of documents: one to each owner of its n-grams, and one to itself.

    Equal sets within the chunk travel once, and so does an n-gram; where several documents of the chunk hold
    it, the list of them stays in the message to itself.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    local = np.arange(len(sets), dtype=np.int64)
    first: dict[tuple, int] = {}
    for i, s in enumerate(sets):
        if len(s):
            local[i] = first.setdefault((len(s), int(np.bitwise_xor.reduce(s)), int(s.sum(dtype=np.uint64)), int(s[0])), i)
    own = [i for i in range(len(sets)) if local[i] == i and len(sets[i])]
    hashes = np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in own)])
    docs = np.repeat(np.array(own, np.int64), sizes[own] if own else 0)
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(hashes)))
    tokens, leads, multi = hashes[starts], docs[starts], counts > 1
    many = np.repeat(multi, counts)
    rows = [
        {
            "key": -1 - chunk, "chunk": chunk, "owner": -1, "doc_ids": keys, "row_keys": row_keys, "sizes": sizes.astype("<u4").tobytes(),
            "local": local.astype("<u2").tobytes(), "lists": docs[many].astype("<u2").tobytes(), "lengths": counts[multi].astype("<u4").tobytes(),
        }
    ]
    owner = ((tokens >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    found, begins = np.unique(owner, return_index=True)
    for o, s, e in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(tokens)], strict=True):
        rows.append(
            {
                "key": o, "chunk": chunk, "owner": o, "tokens": tokens[s : s + 1].tobytes() + narrow(np.diff(tokens[s:e])),
                "leads": leads[s:e].astype("<u2").tobytes(), "multi": np.packbits(multi[s:e]).tobytes(), "counts": counts[s:e][multi[s:e]].astype("<u4").tobytes(),
            }
        )
    return rows


def send(docs: DataFrame, owners: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent = TaskContext.get().partitionId(), 0
        keys: list = []
        row_keys: list = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from as_table(sent_rows((task << 20) + sent, keys, row_keys, sets, owners), SENT).to_batches()

        for batch in batches:
            for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append(key)
                row_keys.append(row)
                sets.append(shingles(word_hashes(text.as_py() or "")))
                held += len(sets[-1])
                if held >= CHUNK or len(keys) >= CHUNK_DOCS:
                    yield from flush()
                    keys, row_keys, sets, held, sent = [], [], [], 0, sent + 1
        if keys:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), row_key(), "text").mapInArrow(run, SENT)


def reply(table: pa.Table) -> pa.Table:
    """An owner's answers: for each message, which of its n-grams are shared, how rare they are, and their first holder.

    A message of a chunk to itself passes through.
    """
    messages = table.to_pylist()
    if messages[0]["owner"] < 0:
        return as_table(messages, REPLY)
    tokens, leads, counts, multis = [], [], [], []
    for m in messages:
        own_leads = np.frombuffer(m["leads"], "<u2").astype(np.int64)
        multi = np.unpackbits(np.frombuffer(m["multi"], np.uint8), count=len(own_leads)).astype(bool)
        own_counts = np.ones(len(own_leads), np.int64)
        own_counts[multi] = np.frombuffer(m["counts"], "<u4")
        tokens.append(unpack_tokens(m["tokens"]))
        leads.append((m["chunk"] << 16) + own_leads)
        counts.append(own_counts)
        multis.append(multi)
    together, number = np.unique(np.concatenate(tokens), return_inverse=True)
    df = np.bincount(number, np.concatenate(counts)).astype(np.int64)
    head = np.full(len(together), np.iinfo(np.int64).max)
    np.minimum.at(head, number, np.concatenate(leads))
    dense = np.cumsum(df > 1) - 1
    rows, begin = [], 0
    for m, own, multi in zip(messages, leads, multis, strict=True):
        mine = number[begin : begin + len(own)]
        begin += len(own)
        keep = np.flatnonzero(df[mine] > 1)
        mine = mine[keep]
        heads, head_at = np.unique(head[mine], return_inverse=True)
        rows.append(
            {
                "chunk": m["chunk"], "owner": m["owner"], "ids": dense[mine].astype("<u4").tobytes(), "at": (own[keep] & 0xFFFF).astype("<u2").tobytes(),
                "multi": np.packbits(multi[keep]).tobytes(), "rarity": np.minimum(255, 8 * np.log2(df[mine])).astype(np.uint8).tobytes(),
                "heads": heads.astype("<i8").tobytes(), "head_at": head_at.astype("<u4").tobytes(),
            }
        )
    return as_table(rows, REPLY)


def unpack_tokens(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u8", 1).astype(np.uint64)
    return np.concatenate([first, first + np.cumsum(widen(data[8:]), dtype=np.uint64)])


GATHERED = "gid long, doc_id long, row_key long, n int, rep long, tokens binary, heads array<bigint>"


def gather(table: pa.Table) -> pa.Table:
    """Back at a chunk: its documents, and for those with enough shared n-grams these, rarest first.

    ``heads`` are the first holders of the n-grams among the rarest that a partner can't all lack; partners meet
    at one of them.
    """
    rows = table.sort_by("owner").to_pylist()
    own, replies = rows[0], rows[1:]
    chunk = own["chunk"]
    sizes = np.frombuffer(own["sizes"], "<u4").astype(np.int64)
    local = np.frombuffer(own["local"], "<u2").astype(np.int64)
    lists, lengths = np.frombuffer(own["lists"], "<u2").astype(np.int64), np.frombuffer(own["lengths"], "<u4").astype(np.int64)
    at, ids, multi, rarity, heads = [], [], [], [], []
    for r in replies:
        own_at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        at.append(own_at)
        ids.append((np.int64(r["owner"]) << 32) + np.frombuffer(r["ids"], "<u4").astype(np.int64))
        multi.append(np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=len(own_at)).astype(bool))
        rarity.append(np.frombuffer(r["rarity"], np.uint8))
        heads.append(np.frombuffer(r["heads"], "<i8")[np.frombuffer(r["head_at"], "<u4")])
    none = np.empty(0, np.int64)
    at, ids, rarity, heads = (np.concatenate([none, *x]).astype(np.int64) for x in (at, ids, rarity, heads))
    multi = np.concatenate([np.empty(0, bool), *multi])
    # Every n-gram that several documents of the chunk hold is shared, so these come back in the order of the lists.
    times = np.ones(len(at), np.int64)
    times[multi] = lengths
    ids, rarity, heads, several = (np.repeat(x, times) for x in (ids, rarity, heads, multi))
    docs = np.repeat(at, times)
    docs[several] = lists
    order = np.lexsort((ids, rarity, docs))
    docs, ids, heads = docs[order], ids[order], heads[order]
    shared = np.bincount(docs, minlength=len(sizes))
    begins = np.cumsum(shared) - shared
    base = chunk << 16
    out = []
    for i, n in enumerate(sizes.tolist()):
        row = {"gid": base + i, "doc_id": own["doc_ids"][i], "row_key": own["row_keys"][i], "n": n, "rep": base + int(local[i])}
        if local[i] == i and n and shared[i] >= needed(n):
            mine = slice(begins[i], begins[i] + shared[i])
            # A partner shares one at least of any n - needed + 1 n-grams; those that nobody shares come first.
            spare = n - needed(n) + 1 - (n - int(shared[i]))
            row["tokens"] = ids[mine].astype("<i8").tobytes()
            row["heads"] = np.unique(heads[mine][:spare])
        out.append(row)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table({f: pa.array([r.get(f) for r in out], k) for f, k in zip(names(GATHERED), kinds, strict=True)})


class Index:
    """Inverted lists of a block of documents: by n-gram, the sorted places of the documents that hold it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.n, self.sizes = len(sets), sizes
        docs = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.tokens, number = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True)
        order = np.lexsort((docs, number))
        self.docs = docs[order]
        self.keys = number[order] * self.n + self.docs
        self.lengths = np.bincount(number, minlength=len(self.tokens))
        self.begins = np.cumsum(self.lengths) - self.lengths

    def lists(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams that have a list."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at[self.tokens[at] == tokens]

    def merged(self, lists: np.ndarray) -> np.ndarray:
        """How often each document occurs in the lists."""
        lengths = self.lengths[lists]
        ends = np.cumsum(lengths)
        at = np.repeat(self.begins[lists] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], minlength=self.n)

    def probed(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How many of the lists hold each of the documents, by binary search."""
        wanted = lists[:, None] * self.n + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted).sum(0)


def search(index: Index, tokens: np.ndarray, n: int, label: np.ndarray, own: int) -> Iterator[int]:
    """Places of documents that link with a query, by DivideSkip; those with the label ``own`` has are passed over.

    ``label`` changes while the search runs: the caller merges labels on every hit, so further documents of a
    group that is linked already need no look.
    """
    lists = index.lists(tokens)
    least = int(needed(n))
    if len(lists) < least:
        return
    lists = lists[np.argsort(index.lengths[lists], kind="stable")]
    longest = int(index.lengths[lists[-1]])
    n_long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    counts = index.merged(short)
    fits = (counts >= least - n_long) & (counts > 0) & (100 * index.sizes >= PERCENT * n) & (100 * n >= PERCENT * index.sizes)
    found = np.flatnonzero(fits)
    found = found[np.argsort(-counts[found], kind="stable")]
    while True:
        found = found[label[found] != label[own]]
        if not len(found):
            return
        now, found = found[:PROBES], found[PROBES:]
        inter = counts[now] + (index.probed(long, now) if len(long) else 0)
        yield from now[linked(inter, n, index.sizes[now])].tolist()


def search_block(table: pa.Table) -> pa.Table:
    """Links of a group of rows (gid, n, tokens, role): 1 is indexed, 2 asks, 3 both; a star for each component."""
    gids, sizes = table.column("gid").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    role = table.column("role").to_numpy()
    sets = [np.frombuffer(t.as_py(), "<i8") for t in table.column("tokens")]
    indexed, asking = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    label = np.arange(len(gids))
    if len(indexed) and len(asking):
        index = Index([sets[i] for i in indexed], sizes[indexed])
        place = np.full(len(gids), -1)
        place[indexed] = np.arange(len(indexed))
        # Labels in the order of the index, then of those that only ask.
        only = np.flatnonzero(place < 0)
        place[only] = len(indexed) + np.arange(len(only))
        for q in asking.tolist():
            own = place[q]
            for hit in search(index, sets[q], int(sizes[q]), label, own):
                if label[hit] != label[own]:
                    label[label == label[hit]] = label[own]
        label = label[place]
    _, group = np.unique(label, return_inverse=True)
    head = np.full(len(gids), np.iinfo(np.int64).max)
    np.minimum.at(head, group, gids)
    head = head[group]
    far = head != gids
    return pa.table({"a": gids[far], "b": head[far]})


LINKS = "a long, b long"


def search_links(sets: DataFrame) -> DataFrame:
    """Links among staged rows (gid, n, tokens, heads) that meet at a head, as far as they join components.

    Small heads are searched many to a task. A head with more than ``BLOCK`` documents is split: all its
    documents ask a first block; only those that end up outside its largest component then ask the others.
    """
    met = sets.select(F.explode("heads").alias("head"), "gid")
    heads = stage(met.groupBy("head").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1"), "heads")
    small, large = heads.filter(F.col("docs") <= BLOCK), stage(heads.filter(F.col("docs") > BLOCK), "large-heads")
    buckets = max(1, total(small, F.col("docs")) // BLOCK)
    routes = stage(met.join(small, "head").select(F.pmod(F.xxhash64("head"), F.lit(buckets)).alias("bucket"), "gid").distinct(), "routes")
    rows = sets.select("gid", "n", "tokens")
    near = routes.join(rows, "gid").withColumn("role", F.lit(3)).select("bucket", "gid", "n", "tokens", "role")
    found = stage(near.groupBy("bucket").applyInArrow(search_block, LINKS), "links")
    if large.isEmpty():
        return found
    # The heads with more than a block of documents: at most one for each block of all rows.
    blocks = F.ceil(F.col("docs") / BLOCK).cast("int")
    split = stage(
        met.join(large, "head").select("head", "gid", "docs", F.pmod(F.xxhash64("gid"), blocks).cast("int").alias("block")).join(rows, "gid"), "large"
    )
    asks = split.select("head", "block", "gid", "n", "tokens", F.when(F.col("block") == 0, 3).otherwise(2).alias("role"))
    first = split.filter("block = 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.greatest(blocks - 1, F.lit(1)))))
    known = first.select("head", "block", "gid", "n", "tokens", F.lit(1).alias("role"))
    one = asks.unionByName(known).groupBy("head", "block").applyInArrow(lambda t: search_block(t), LINKS)
    found = stage(found.unionByName(one), "links")
    labels = components(found)
    placed = split.select("head", "gid", "block").join(labels.withColumnRenamed("node", "gid"), "gid", "left")
    placed = stage(placed.withColumn("label", F.coalesce("label", "gid")), "placed")
    per = placed.groupBy("head", "label").agg(F.count(F.lit(1)).alias("members"))
    main = per.groupBy("head").agg(F.max(F.struct("members", "label")).alias("top")).select("head", F.col("top.label").alias("main"))
    open_ = placed.join(main, "head").filter("label != main").select("head", "gid")
    sizes = open_.groupBy("head").agg(F.count(F.lit(1)).alias("open_docs"))
    parts = F.ceil(F.col("open_docs") / BLOCK).cast("int")
    known = split.join(sizes, "head").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    known = known.filter("block > 0").select("head", "block", "part", "gid", "n", "tokens", F.lit(1).alias("role"))
    asks = split.drop("block").join(open_, ["head", "gid"]).join(sizes, "head").withColumn("part", F.pmod(F.xxhash64("gid"), parts).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(1), blocks - 1))).select("head", "block", "part", "gid", "n", "tokens", F.lit(2).alias("role"))
    # A row may ask the block that it is in: it meets itself there and passes on.
    two = asks.unionByName(known).groupBy("head", "block", "part").applyInArrow(lambda t: search_block(t), LINKS)
    return stage(found.unionByName(two), "links")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    N-grams are of words in lower case (A-Z only), split at ASCII white space. Null and empty texts and texts
    without words have no n-grams and no links. Null doc_ids take part but never name a component that has
    another; rows that repeat a doc_id are rows of their own. Other columns are ignored; an empty table gives none.
    """
    size = total(docs, F.octet_length("text"))
    owners = max(OWNERS, math.ceil(size / OWNED))
    answers = stage(send(docs, owners).groupBy("key").applyInArrow(lambda t: reply(t), REPLY), "replies", "zstd")
    rows = stage(answers.groupBy("chunk").applyInArrow(lambda t: gather(t), GATHERED), "documents", "zstd")
    sets = rows.filter("tokens is not null").select("gid", "n", "tokens", "heads")
    copies = rows.filter("rep != gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    labels = components(search_links(sets).unionByName(copies)).withColumnRenamed("node", "gid")
    placed = stage(rows.select("gid", "doc_id", "row_key", "n").join(labels, "gid", "left"), "placed")
    names_ = placed.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    found = attach(placed, stage(names_, "components"), "label", "members")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the near copies of a row with a smaller doc_id, with all their columns."""
    found = stage(members(docs), "members")
    gone = stage(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("row_key"), "copies")
    kept = without(docs, gone)
    again = stage(found.join(gone, "row_key", "left_anti").groupBy("row_key").count().filter("count > 1").select("row_key"), "repeated")
    if again.isEmpty():
        return kept
    marked = with_maybe(packed(kept, row_key().alias("row_key")), "row_key", again, "row_key")
    return marked.filter("not maybe").unionByName(marked.filter("maybe").dropDuplicates(["row_key"])).select("row.*")

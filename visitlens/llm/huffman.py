"""Token ids as canonical, length-limited Huffman codes in independent blocks.

Ids are counted over the whole corpus, one code book is built from the counts, and every block of documents
is packed on its own, with the bit offset of every ``EVERY``-th id, so that a reader can start there and can
decode many stretches of a block at once by table lookup. The files are Parquet tables of blocks, written by
Spark's committers: a lost task leaves no partial file, and any store that Spark writes to will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.shared import shared_folder, stage

#: Ids in a block; a longer document makes a longer block.
BLOCK = 1 << 18
#: Ids between two checkpoints of a block.
EVERY = 128
#: Longest code in bits.
LONGEST = 20
#: Entries of a worker's word cache before a new generation begins; the one before it is still looked up.
CACHE = 3 << 17

# The split pattern of the word tokenizer file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder(dict):
    """Words of bytes without white space to their ids, as bytes of ``dtype``.

    The tokenizer drops white space and splits nothing across it, so a text's ids are those of its words in a
    row. Texts without control characters below U+0300 are in NFC and have lower case letter by letter, so
    their words go to the model piece by piece; anything else, and a text in which an added token of the file
    occurs, goes through the whole tokenizer.
    """

    def __init__(self, json: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.whole, self.dtype = Tokenizer.from_str(json), dtype
        self.by_piece = PRETOKEN in json.replace("\\\\", "\\") and '"Lowercase"' in json and '"ByteLevel"' in json
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.by_piece &= not any(c.isspace() for t in self.added for c in t)
        self.find = regex.compile(PRETOKEN).findall
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            ids = self.piece(text) if text.isalpha() else b"".join(map(self.piece, self.find(text)))
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE:
                self.older_pieces, self.pieces = self.pieces, {}
            ids = self.older_pieces.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
                ids = np.array([t.id for t in self.whole.model.tokenize(shown)], self.dtype).tobytes()
            self.pieces[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        data = text.encode()
        if self.by_piece and not data.translate(None, LOW):
            lower = text.lower()
            if not any(t in lower for t in self.added):
                return b"".join(map(self.__getitem__, lower.encode().split()))
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()


#: Bytes of characters below U+0300 other than controls.
LOW = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xCC)])


@dataclass
class Code:
    """A canonical code: ids in code order and their lengths in bits."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.lengths))
        self.ids, self.lengths = self.ids[order].astype(np.int64), self.lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        width = np.left_shift(1, self.bits - self.lengths)
        first = np.cumsum(width) - width
        self.codes = first >> (self.bits - self.lengths)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: code and length."""
        n = int(self.ids.max(initial=0)) + 1
        codes, lengths = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths

    def table(self) -> np.ndarray:
        """By the next ``bits`` bits: id * 64 + length."""
        table = np.zeros(1 << self.bits, np.int64)
        filled = np.repeat(self.ids * 64 + self.lengths, np.left_shift(1, self.bits - self.lengths))
        table[: len(filled)] = filled
        return table


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits, by package merging."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids do not fit codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    items = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([items, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs].reshape(-1, 2).sum(1)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(levels):
        taken = int(own[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    result = np.empty(n, np.int64)
    result[order] = lengths
    return result


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` in a row, high bits first, and the bit offset of every ``EVERY``-th id."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    word, room = begin >> 6, 64 - (begin & 63) - size
    value = codes[ids]
    over = np.flatnonzero(room < 0)
    part = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    words[word[starts]] = np.bitwise_or.reduceat(part, starts)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3)], begin[::EVERY]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The ``n`` ids of a block; all stretches between checkpoints advance together."""
    if not n:
        return np.empty(0, np.int64)
    spare = (EVERY * bits >> 3) + 24
    padded = payload + bytes(spare + -(len(payload) + spare) % 8)
    words = np.frombuffer(padded, ">u8").astype(np.uint64)
    at = checkpoints.astype(np.int64)
    out = np.empty((EVERY, len(at)), np.int64)
    last, down = len(words) - 2, np.uint64(64 - bits)
    for step in range(EVERY):
        word = np.minimum(at >> 6, last)
        shift = (at & 63).astype(np.uint64)
        window = words[word] << shift | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - shift)
        entry = table[(window >> down).astype(np.int64)]
        out[step] = entry >> 6
        at = at + (entry & 63)
    return out.T.reshape(-1)[:n]


BLOCKS = "part int, block int, part_start long, n_tokens long, doc_ids array<bigint>, lens array<bigint>, ids binary"
FILES = "part int, block int, start long, n_tokens long, doc_ids array<bigint>, lens array<bigint>, payload binary, checkpoints binary"


def tokenised_blocks(docs: DataFrame, tokenizer_json: str, end_id: int, dtype: str) -> DataFrame:
    """Blocks of whole documents in ascending ``doc_id`` order within and across parts; ids not yet coded."""
    # The vocabulary file, of fixed size. A worker keeps a broadcast value, with what it has learnt, from task to task.
    shipped = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in shipped.value:
            shipped.value["encoder"] = Encoder(shipped.value["json"], dtype)
        encoder = shipped.value["encoder"]
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        part, block, done = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        lens: list[int] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, done, keys, lens, ids
            n = sum(lens)
            row = {"part": [part], "block": [block], "part_start": [done], "n_tokens": [n], "doc_ids": [keys], "lens": [lens]}
            row["ids"] = [b"".join(ids)]
            block, done, keys, lens, ids = block + 1, done + n, [], [], []
            return pa.RecordBatch.from_pydict(row, SCHEMA)

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encoder.text(text.as_py() or "") + end
                keys.append(key)
                lens.append(len(got) // width)
                ids.append(got)
                held += lens[-1]
                if held >= BLOCK:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS)


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("part_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lens", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count_ids(blocks: DataFrame, dtype: str) -> DataFrame:
    """Global counts: each task adds up its own ids first and sends a row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                got = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(got) > len(counts):
                    counts = np.pad(counts, (0, len(got) - len(counts)))
                counts[: len(got)] += got
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, longest: int = LONGEST) -> None:
    """Tokenises ``docs`` and writes the code book and the coded blocks under ``path``.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty and gets the end id alone;
    null doc_ids come first; repeated ids are kept, ordered by text; an empty table gives empty files.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        json = file.read()
    vocabulary = Tokenizer.from_str(json).get_vocab_size()
    dtype = id_type(max(vocabulary, end_id + 1))
    blocks = stage(tokenised_blocks(docs, json, end_id, dtype), "token-blocks", "zstd")
    counts = count_ids(blocks, dtype).orderBy("id").toPandas()  # a row per id of the vocabulary at most
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    longest = max(longest, len(ids).bit_length() + 2)
    code = Code(ids, code_lengths(n, longest))
    spark = docs.sparkSession
    book = list(zip(code.ids.tolist(), code.lengths.tolist(), strict=True))
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/book")
    codes, lengths = code.encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload, marks = pack(np.frombuffer(batch.column("ids")[i].as_buffer(), dtype).astype(np.int64), codes, lengths)
                own = batch.slice(i, 1)
                arrays = [own.column(c) for c in ("part", "block", "start", "n_tokens", "doc_ids", "lens")]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array([payload], pa.binary()), pa.array([marks.astype("<u8").tobytes()], pa.binary())],
                    ["part", "block", "start", "n_tokens", "doc_ids", "lens", "payload", "checkpoints"],
                )

    # A row for each write task, 16 bytes each: small enough to broadcast at any size of the corpus.
    ends = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    begins = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    placed = blocks.join(F.broadcast(begins), "part").withColumn("start", F.col("begin") + F.col("part_start"))
    placed.select("part", "block", "start", "n_tokens", "doc_ids", "lens", "ids").mapInArrow(run, FILES).write.option(
        "compression", "none"
    ).parquet(f"{path}/blocks")


def read_book(spark: SparkSession, path: str) -> Code:
    book = spark.read.parquet(f"{path}/book").toPandas()  # a row per id of the vocabulary at most
    return Code(book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents in the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    code = read_book(spark, path)
    table, bits = code.table(), code.bits
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.frombuffer(row["checkpoints"], "<u8")
                ids = unpack(row["payload"], marks, row["n_tokens"], table, bits).astype("<u4")
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(sums, pa.int64())]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared one and reads the files back, one row per document."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, with_ids)

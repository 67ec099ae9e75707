import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from visitlens.llm import huffman
from visitlens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path(), encoding="utf-8") as file:
        return huffman.Encoder(file.read(), "<u2")


@pytest.mark.parametrize(
    "text",
    ["", "Plain words, it's 12 o'clock!", "ÀÉ straße İstanbuĺ é", "日本 　 x\x1cy\x85z\xa0w", "a" * 3000, "\U0001f600%%% @@@\n\t b"],
)
def test_encoder_equals_the_tokenizer(encoder, whole, text):
    assert np.frombuffer(encoder.text(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 50, 300])
@pytest.mark.parametrize("longest", [9, 12])
def test_lengths_make_a_full_code_within_the_limit(n, longest):
    counts = np.array([int(1.7**min(i, 60)) + 1 for i in range(n)])
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest and (2.0**-lengths).sum() <= 1
    if n > 1:
        assert (2.0**-lengths).sum() == 1


def test_lengths_are_optimal_where_the_limit_is_slack():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    want = np.zeros(len(counts), int)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        want[x + y] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    assert (huffman.code_lengths(counts, 20) * counts).sum() == (want * counts).sum()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 4000
    found = np.bincount(np.append(ids, 1))
    kinds = np.flatnonzero(found)
    code = huffman.Code(kinds, huffman.code_lengths(found[kinds], 14))
    codes, lengths = code.encoder()
    payload, marks = huffman.pack(ids, codes, lengths)
    assert huffman.unpack(payload, marks, n, code.table(), code.bits).tolist() == ids.tolist()


def expected(rows, whole):
    out, start = [], 0
    for key, text in sorted(((k, t or "") for k, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_read_back(docs_of, odd_rows, whole, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 500)
    got = huffman.encode_and_read(docs_of(odd_rows), tokenizer_path()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(odd_rows, whole)


def test_ids_read_back(docs_of, whole):
    got = huffman.encode_and_read(docs_of([(1, "some words here"), (2, None)]), tokenizer_path(), with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [[*whole.encode("some words here", add_special_tokens=False).ids, 1], [1]]


def test_empty_table(docs_of):
    assert huffman.encode_and_read(docs_of([]), tokenizer_path()).count() == 0


def test_other_columns_may_clash(docs_of):
    docs = docs_of([(1, "a b"), (2, "c")]).selectExpr("doc_id", "text", "1 as part", "2 as block", "3 as start", "4 as ids")
    assert huffman.encode_and_read(docs, tokenizer_path()).count() == 2


MARKED = ["a <|endoftext|> b", "<|startoftext|>One<|endoftext|><|endoftext|>", "é <|EndOfText|> <|endoftext| >", "日本 <|endoftext|>"]


@pytest.mark.parametrize("text", MARKED)
def test_markers_in_a_text_are_read_as_the_tokenizer_reads_them(encoder, whole, text):
    ids = np.frombuffer(encoder.text(text), "<u2").tolist()
    assert ids == whole.encode(text, add_special_tokens=False).ids
    assert (49407 in ids) == ("<|endoftext|>" in text) and (49406 in ids) == ("<|startoftext|>" in text)


def test_files_with_markers_read_back(docs_of, whole):
    rows = [(i, text) for i, text in enumerate([*MARKED, "the last one"])]
    got = huffman.encode_and_read(docs_of(rows), tokenizer_path()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, whole)

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from visitlens.llm import suffix_dedup


@pytest.mark.parametrize("wide", [1024, 2])
def test_suffix_array(wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rng = random.Random(wide)
    for _ in range(150):
        s = np.array([rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(0, 200))] + [0])
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())


def test_common_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        s = np.array([rng.randint(1, 2) for _ in range(rng.randint(1, 60))] + [0])
        hashes = suffix_dedup.Hashes(suffix_dedup.mix(s.astype(np.uint64) + np.uint64(9)), suffix_dedup.Powers())
        order = suffix_dedup.suffix_array(s)
        got = suffix_dedup.common_prefixes(order, s, hashes, 100)
        for a, b in zip(order, order[1:], strict=False):
            n = next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k])
            assert got[b] == n


def brute(rows, width):
    texts = [(key, (text or "").encode()) for key, text, *_ in rows]
    counts = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for key, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(1, rng.choice([*shared, "", shared[0][: rng.randint(1, 150)]]))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("crowd", [4096, 2])
@pytest.mark.parametrize("width", [40, 64])
def test_passages(docs_of, crowd, width, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rows = passages()
    got = suffix_dedup.without_repeats(docs_of(rows), width).collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=repr) == brute(rows, width)


@pytest.mark.parametrize("piece", [1 << 20, 3000])
def test_odd_rows(docs_of, odd_rows, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = [(k, t and t[:60_000]) for k, t, *_ in odd_rows]
    got = suffix_dedup.without_repeats(docs_of(rows)).collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=repr) == brute(rows, 200)


def test_small_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    got = suffix_dedup.without_repeats(sf_docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == [r[:5] for r in brute(rows, 200)]


def test_empty_table(docs_of):
    assert suffix_dedup.without_repeats(docs_of([])).count() == 0


def test_short_common_prefixes_may_be_left_out():
    rng = random.Random(4)
    for _ in range(60):
        s = np.array([rng.randint(1, 2) for _ in range(rng.randint(1, 80))] + [0])
        hashes = suffix_dedup.Hashes(suffix_dedup.mix(s.astype(np.uint64) + np.uint64(9)), suffix_dedup.Powers())
        order = suffix_dedup.suffix_array(s)
        whole = suffix_dedup.common_prefixes(order, s, hashes, 100)
        assert suffix_dedup.common_prefixes(order, s, hashes, 100, 4).tolist() == np.where(whole >= 4, whole, 0).tolist()

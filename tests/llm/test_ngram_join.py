from collections import Counter, defaultdict

import numpy as np
import pytest

from visitlens.llm import ngram_join
from visitlens.llm.components import components
from visitlens.llm.shared import word_hashes


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        span = min(5, len(words))
        sets.append({tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for own in groups.values():
        named = [rows[i][0] for i in own if rows[i][0] is not None]
        out.extend((rows[i][0], len(sets[i]), min(named, default=None)) for i in own)
    return sorted(out, key=repr)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.members(docs).collect()), key=repr)


def near_copies(n_groups=12, seed=5):
    """Groups whose members differ by some words, chained so that ends are linked only through the middle."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 40))
    rows = []
    for g in range(n_groups):
        words = list(rng.choice(vocabulary, int(rng.integers(4, 120))))
        for _ in range(int(rng.integers(1, 9))):
            words = words.copy()
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            text = " ".join(words)
            rows.append((len(rows), f"{passage} {text}" if g % 3 == 0 else text))
    return rows


@pytest.mark.parametrize("block", [2048, 4])
@pytest.mark.parametrize("chunk", [1 << 22, 300])
def test_near_copies(docs_of, block, chunk, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "OWNED", 2000)
    rows = near_copies()
    assert found(docs_of(rows)) == brute(rows)


@pytest.mark.parametrize("block", [2048, 8])
def test_odd_rows(docs_of, odd_rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert found(docs_of(odd_rows)) == brute(odd_rows)


def test_small_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert found(sf_docs) == brute(rows)


def test_threshold_is_exact(docs_of):
    words = [f"t{i}" for i in range(40)]
    base = " ".join(words)
    # 36 shingles; a change at either end takes one away, and 36 + k distinct in all.
    rows = [(k, " ".join([f"new{i}" for i in range(k)] + words[k:])) for k in range(12)] + [(50, base)]
    assert found(docs_of(rows)) == brute(rows)


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(200)]
    sizes = np.array([len(s) for s in sets])
    index = ngram_join.Index(sets, sizes)
    for q, tokens in enumerate(sets):
        label = np.arange(len(sets))
        got = set(ngram_join.search(index, tokens, len(tokens), label, q))
        counts = Counter(j for j, s in enumerate(sets) for _ in np.intersect1d(tokens, s))
        assert got == {j for j, c in counts.items() if j != q and 100 * c >= 75 * (len(tokens) + len(sets[j]) - c)}


def test_messages_round_trip():
    sets = [ngram_join.shingles(word_hashes(t)) for t in ("a b c d e f g", "a b c d e f g", "x", "", "a b c d e q r")]
    rows = ngram_join.sent_rows(7, [1, 2, 3, 4, 5], [0] * 5, sets, 3)
    sent = np.concatenate([ngram_join.unpack_tokens(r["tokens"]) for r in rows if r["owner"] >= 0])
    assert sorted(sent.tolist()) == sorted(set(np.concatenate(sets).tolist()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}
    assert got == want


def test_one_of_each(docs_of, odd_rows):
    rows = near_copies() + [(k + 1000 if k else k, t) for k, t, *_ in odd_rows]
    docs = docs_of(rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    want = {c for _, _, c in brute(rows) if c is not None}
    assert {k for k in got if k is not None} == want and all(n == 1 for k, n in got.items() if k is not None)


def test_empty_table(docs_of):
    assert ngram_join.members(docs_of([])).count() == 0 and ngram_join.one_of_each(docs_of([])).count() == 0

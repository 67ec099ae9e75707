import hashlib
from collections import defaultdict

import numpy as np
import pytest

from visitlens.llm import exact_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    assert exact_dedup.ungolomb(exact_dedup.golomb(values)).tolist() == values.tolist()
    dense = np.arange(n, dtype=np.uint64) + np.uint64((1 << 64) - 2000)
    assert exact_dedup.ungolomb(exact_dedup.golomb(dense)).tolist() == dense.tolist()


def test_golomb_is_smaller_than_the_hashes():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000).astype(np.uint64))
    assert len(exact_dedup.golomb(values)) < 0.45 * values.nbytes


def expected(rows):
    groups = defaultdict(list)
    for key, text, *_ in rows:
        groups[text or ""].append(key)
    out = []
    for key, text, *_ in rows:
        own = groups[text or ""]
        keep = max((k for k in own if k is not None), default=None)
        out.append((key, keep, len(own), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 22, 7])
def test_groups(docs_of, odd_rows, chunk, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    monkeypatch.setattr(exact_dedup, "OWNED", 20)
    got = exact_dedup.exact_duplicates(docs_of(odd_rows, 5)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(odd_rows)


def test_suspects_are_the_repeated_values(spark):
    rows = spark.range(500).selectExpr("id % 400 - 200 as v").repartition(4)
    got = sorted(r[0] for r in exact_dedup.suspects(rows, 5, 30).collect())
    assert got == list(range(-200, -100))


def test_empty_table(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0

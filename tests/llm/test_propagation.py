import zlib
from collections import Counter, defaultdict

import pytest

from visitlens.llm import propagation


def check(rows, got, shards=8):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (k is not None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows
    )
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def spread(got):
    """Shards of each group of equal texts."""
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[r.text_crc32, r.size].add(r.shard)
        sizes[r.text_crc32, r.size] += 1
    return {k: (sizes[k], len(v)) for k, v in shards.items()}


@pytest.mark.parametrize("run", [(256, 4096), (4, 4)])
def test_odd_rows(docs_of, odd_rows, run, monkeypatch):
    monkeypatch.setattr(propagation, "RUN", run)
    check(odd_rows, propagation.sharded(docs_of(odd_rows)).collect())


def test_groups_come_together(docs_of):
    rows = [(g * 10 + i, f"text of group {g}") for g in range(40) for i in range(2 + g % 4)] + [(1000 + i, f"single {i}") for i in range(300)]
    got = propagation.sharded(docs_of(rows)).collect()
    check(rows, got)
    assert sum(n > 1 and shards > 1 for n, shards in spread(got).values()) <= 3


def test_a_group_larger_than_a_shard_fills_few(docs_of):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"single {i}") for i in range(800)]
    got = propagation.sharded(docs_of(rows)).collect()
    check(rows, got)
    assert spread(got)[zlib.crc32(b"hot"), 4][1] <= 4


def test_deterministic(sf_docs):
    a, b = (sorted(map(tuple, propagation.sharded(d).collect())) for d in (sf_docs, sf_docs.repartition(5)))
    assert a == b


@pytest.mark.parametrize("n", [0, 1, 7, 9])
def test_few_rows(docs_of, n):
    rows = [(i, "same") for i in range(n)]
    check(rows, propagation.sharded(docs_of(rows)).collect())


def test_only_built_in_functions(sf_docs):
    plan = propagation.sharded(sf_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

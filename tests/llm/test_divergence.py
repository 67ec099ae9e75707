import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.llm import divergence


def brute(rows, least_docs, best):
    """rows: (lang, source, text)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold))
        n[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least_docs]
        part = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}
        total = Counter()
        for s in sources:
            total.update(n[lang, s])
        q, p = part(total), {s: part(n[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pair, None), ("term", term, best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, name, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, least_docs, best, parts=5):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts)
    got = divergence.audit(docs.withColumns({c: F.lit(0) for c in ("n", "p", "docs", "term", "item", "tile")}), least_docs, best)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed, n=120, sources=7):
    rng = random.Random(seed)
    terms = [f"{a}{b}" for a in "abcéß日" for b in ("", "x", "Y", "ü")]
    rows = []
    for _ in range(n):
        s = rng.choice(["hot"] * sources + [f"s{i}" for i in range(sources)])
        weights = [1 + (hash((s, i)) % 5) for i in range(len(terms))]
        rows.append((rng.choice(["en", "de"]), s, " ".join(rng.choices(terms, weights, k=rng.randint(0, 30))) + ", 12 A-b."))
    return rows


@pytest.mark.parametrize(("tile", "block"), [(256, 4096), (2, 5)])
def test_audit(spark, tile, block, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "NEW_ROWS", 6)
    monkeypatch.setattr(divergence, "ALL_ROWS", 30)
    rows = sample(1)
    assert audited(spark, rows, 4, 3) == brute(rows, 4, 3)


def test_odd_rows(spark):
    rows = [(None, None, None), ("en", None, "one two"), ("en", "a", ""), ("en", "a", "one ONE éÉ"), ("en", "b", "one two"), ("xx", "b", "123 .,")]
    rows += [("en", "a", "one ONE éÉ")] * 3 + [("fr", "z", "word " * 20_000)]
    assert audited(spark, rows, 2, 50) == brute(rows, 2, 50)
    assert audited(spark, rows, 100, 50) == brute(rows, 100, 50)


def test_empty(spark):
    assert audited(spark, [], 1, 5) == []


def test_one_hot_group(spark):
    rows = [("en", "hot" if i % 3 else f"s{i % 4}", f"w{chr(97 + i % 26)} common w{chr(97 + i % 7)}") for i in range(400)]
    assert audited(spark, rows, 2, 4, parts=9) == brute(rows, 2, 4)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband(k):
    rng = random.Random(k)
    for size in (0, 1, 40, 1500):
        n, lang = (np.array([rng.randint(1, 12) for _ in range(size)], np.int64) for _ in range(2))
        terms = rng.sample([f"t{i}é" for i in range(3000)], size)
        rows = list(zip(n.tolist(), lang.tolist(), [t.encode() for t in terms], strict=True))
        over = lambda a, b: a[0] >= b[0] and a[1] <= b[1] and a[2] < b[2]
        want = [i for i, b in enumerate(rows) if sum(over(a, b) for a in rows) < k]
        assert sorted(divergence.skyband(n, lang, terms, k).tolist()) == want

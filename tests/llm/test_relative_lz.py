import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.llm import relative_lz


def brute(rows, width):
    """Rows with one doc_id must have one text."""
    texts = {(r[0] is not None, r[0] or 0): re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    seen, gone = set(), {}
    for key, words in sorted(texts.items()):
        gone[key] = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[key][i : i + width] = [True] * width
            seen.add(window)
    out = []
    for doc_id, *_ in rows:
        words, marks = texts[doc_id is not None, doc_id or 0], gone[doc_id is not None, doc_id or 0]
        kept = " ".join(w for w, g in zip(words, marks, strict=True) if not g)
        out.append((doc_id, len(words), sum(marks), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def result(docs, *args):
    return sorted((tuple(r) for r in relative_lz.without_repeats(docs, *args).collect()), key=repr)


def passages(seed, docs=70):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ce", "é", "日本", *[f"w{i}" for i in range(40)]])
    shared = [[word() for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(docs):
        words = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            begin = rng.randint(0, 50)
            part = part[begin : begin + rng.randint(0, 50)]
            for _ in range(rng.randint(0, 2)):
                if part:
                    part[rng.randrange(len(part))] = word()
            words += part + [word() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.1:
            words += [rng.choice("ab")] * rng.randint(0, 40)
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("width", "grams", "block", "home"), [(6, (3, 4, 6), 1 << 16, 1 << 16), (6, (2, 4, 6), 40, 12), (9, (3, 6, 9), 5000, 30), (20, (8, 14, 20), 64, 1 << 16)])
def test_passages(docs_of, width, grams, block, home, monkeypatch):
    monkeypatch.setattr(relative_lz, "BLOCK", block)
    monkeypatch.setattr(relative_lz, "HOME", home)
    monkeypatch.setattr(relative_lz, "PIECE", 50)
    monkeypatch.setattr(relative_lz, "STRETCH", 16)
    rows = passages(width + block)
    assert result(docs_of(rows), width, grams) == brute(rows, width)


@pytest.mark.parametrize("home", [1 << 16, 3])
def test_a_passage_in_most_documents(docs_of, home, monkeypatch):
    """One anchor with a context of its own in every document."""
    monkeypatch.setattr(relative_lz, "HOME", home)
    stock = [f"s{i}" for i in range(16)]
    rows = [(i, " ".join([f"x{i}", f"y{i % 7}", *stock, f"z{i % 5}", f"q{i % 11}", "end"])) for i in range(150)]
    rows += [(200 + i, " ".join(stock * 3)) for i in range(20)]
    assert result(docs_of(rows)) == brute(rows, 20)


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(None, "a null id " * 30), (None, "a null id " * 30)]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("row_key", "maybe", "map_no", "map_at", "offset", "content", "begin", "home", "block")})
    assert result(docs) == brute(rows, 20)


def test_empty(docs_of):
    assert result(docs_of([])) == []
    assert result(docs_of([(1, "too short"), (2, "too short")])) == brute([(1, "too short"), (2, "too short")], 20)


def test_sf_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert result(sf_docs) == brute(rows, 20)


def test_longest_earlier_matches_and_factors():
    rng = random.Random(5)
    for _ in range(40):
        texts = [np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 25))], np.uint64) for _ in range(rng.randint(1, 5))]
        longest, begins, ends = relative_lz.longest_earlier(texts)
        line = [x for i, t in enumerate(texts) for x in [*t.tolist(), -1 - i]]
        same = lambda a, b: next(k for k in range(len(line) + 1) if max(a, b) + k >= len(line) or line[a + k] != line[b + k])
        want = [max((same(p, q) for q in range(p)), default=0) for p in range(len(line))]
        assert longest.tolist() == want
        cuts = relative_lz.factors(longest, begins, ends).tolist()
        at = []
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            p = b
            while p < e:
                at.append(p)
                p += max(1, want[p])
            at.append(e)
        assert cuts == at

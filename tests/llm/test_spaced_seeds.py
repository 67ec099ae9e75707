from itertools import combinations

import numpy as np
import pytest

from visitlens.llm import spaced_seeds
from visitlens.llm.shared import word_hashes


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(i, " ".join(f"b{i}x{j}" for j in range(n))) for i, n in enumerate((40, 14, 13, 9, 5, 4, 300))] + [(90, None), (91, ""), (92, "one two")]
    return spark.createDataFrame(rows, "item_id long, text string")


def item(i, n):
    return [f"b{i}x{j}" for j in range(n)]


def clean(n, seed):
    return [f"c{x}" for x in np.random.default_rng(seed).integers(0, 50, n)]


def judged(docs, bench):
    return {r.doc_id: r for r in spaced_seeds.judged(docs, bench).collect()}


def test_overlaps(docs_of, bench):
    swapped = item(0, 40)
    for i in range(5, 40, 7):
        swapped[i] = "other"
    half = item(6, 300)[100:160]
    rows = [
        (1, " ".join(clean(50, 1) + item(0, 40) + clean(50, 2))),
        (2, " ".join(clean(9, 3) + swapped)),
        (3, " ".join(half)),
        (4, " ".join(clean(5, 4) + item(0, 40)[:9] + clean(30, 5))),
        (5, " ".join(clean(400, 6))),
        (6, " ".join(clean(3, 7) + item(3, 9) + clean(3, 8)).upper()),
        (7, " ".join(item(4, 5))),
        (8, " ".join(item(5, 4))),
        (9, " ".join(item(1, 14) + clean(4000, 9) + item(2, 13))),
        (10, "one two"),
        (11, None),
        (12, ""),
    ]
    got = judged(docs_of(rows), bench)
    assert {k for k, r in got.items() if r.contaminated} == {1, 2, 3, 6, 7, 9}
    assert got[1].item_ids == [0] and got[1].overlap_words == 40 and got[9].item_ids == [1, 2]
    assert got[3].overlap_words == 60 and got[5].item_ids == [] and len(got) == len(rows)


def test_small_table_against_brute_force(spark, sf_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [word_hashes(r.text) for r in bench.collect()]
    want = set()
    for r in sf_docs.collect():
        words = word_hashes(r.text or "")
        for own in items:
            for shift in range(-len(own) + 1, len(words)):
                length, equal, _ = spaced_seeds.best_overlap(words, own, shift)
                if length >= min(13, len(own)) and equal >= 0.8 * length:
                    want.add(r.doc_id)
    got = {k for k, r in judged(sf_docs, bench).items() if r.contaminated}
    assert got == want and want


def test_best_overlap():
    doc, own = np.arange(20), np.arange(5, 15)
    assert spaced_seeds.best_overlap(doc, own, 5) == (10, 10, 5)
    assert spaced_seeds.best_overlap(doc, own, 6)[0] == 0
    assert spaced_seeds.best_overlap(doc, own, 40) == (0, 0, 0)
    changed = own.copy()
    changed[4] = -1
    assert spaced_seeds.best_overlap(doc, changed, 5) == (10, 9, 5)


def test_filter_and_odd_rows(docs_of, odd_rows, bench):
    hot = [(500 + i, " ".join(item(0, 40) + [f"d{i}"])) for i in range(40)]
    docs = docs_of(odd_rows + hot)
    kept = spaced_seeds.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert len(spaced_seeds.judged(docs, bench).collect()) == len(odd_rows) + 40


def test_empty_tables(spark, docs_of, bench, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert spaced_seeds.judged(docs_of([]), bench).count() == 0
    assert spaced_seeds.decontaminated(docs_of(odd_rows), none).count() == len(odd_rows)


def by_rule(doc, own):
    """Whether any stretch of any diagonal has enough words, four of five of them equal."""
    least = min(13, len(own))
    shifts = np.subtract.outer(np.arange(len(doc)), np.arange(len(own)))[doc[:, None] == own[None, :]]
    for shift in (x for x in np.unique(shifts) if (shifts == x).sum() * 5 >= least * 4):
        begin, end = max(0, shift), min(len(doc), shift + len(own))
        sums = np.concatenate([[0], np.cumsum(doc[begin:end] == own[begin - shift : end - shift])])
        if any(5 * (sums[j] - sums[i]) >= 4 * (j - i) for i in range(len(sums)) for j in range(i + least, len(sums))):
            return True
    return False


@pytest.mark.parametrize(("n", "differing"), [(5, 1), (9, 1), (10, 2), (12, 2), (13, 2), (15, 3), (20, 4)])
def test_overlap_with_differing_words_anywhere(n, differing):
    own = np.arange(n)
    for places in combinations(range(n), differing):
        doc = np.concatenate([np.full(7, -1), own, np.full(9, -2)])
        doc[[7 + x for x in places]] = -3
        length, equal, _ = spaced_seeds.best_overlap(doc, own, 7)
        assert length >= min(13, n) and 5 * equal >= 4 * length
        first = next(x for x in range(n) if x not in places)
        doc[7 + first] = -3
        assert bool(spaced_seeds.best_overlap(doc, own, 7)[0]) == by_rule(doc, own)


def test_longest_overlap_of_a_diagonal():
    rng = np.random.default_rng(5)
    for n in (6, 13, 30, 60):
        for _ in range(300):
            own = np.arange(n)
            doc = np.where(rng.random(n) < rng.choice([0.6, 0.75, 0.85]), own, -1)
            assert bool(spaced_seeds.best_overlap(doc, own, 0)[0]) == by_rule(doc, own)


def test_small_table_against_the_rule(spark, sf_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [word_hashes(r.text) for r in bench.collect()]
    want = {r.doc_id for r in sf_docs.collect() if any(by_rule(word_hashes(r.text or ""), own) for own in items)}
    assert {k for k, r in judged(sf_docs, bench).items() if r.contaminated} == want


@pytest.mark.parametrize(("n", "differing"), [(13, 2), (15, 3), (20, 4), (25, 5)])
def test_masks_fit_between_differing_words_anywhere(n, differing):
    kept = [sum(1 << i + at for i, on in enumerate(m) if on == "1") for m in spaced_seeds.MASKS for at in range(n - len(m) + 1)]
    bad = np.array([sum(1 << x for x in places) for places in combinations(range(n), differing)])
    hit = np.zeros(len(bad), bool)
    for mask in kept:
        hit |= bad & mask == 0
    assert hit.all()


def test_substitutions_at_every_place_are_found(spark, docs_of):
    sizes = [5, 6, 7, 8, 9, 10, 11, 12, 13, 15]
    bench = spark.createDataFrame([(n, " ".join(item(n, n))) for n in sizes], "item_id long, text string")
    rows, want = [], {}
    for n in sizes:
        for more in (0, 1):
            for places in combinations(range(n), n // 5 + more):
                words = item(n, n)
                for x in places:
                    words[x] = "other"
                words = ["before", *words, "after"]
                want[len(rows)] = more == 0 or by_rule(word_hashes(" ".join(words)), word_hashes(" ".join(item(n, n))))
                rows.append((len(rows), " ".join(words)))
    got = judged(docs_of(rows), bench)
    assert {k for k, r in got.items() if r.contaminated} == {k for k, w in want.items() if w}

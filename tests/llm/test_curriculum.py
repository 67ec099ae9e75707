import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from visitlens.llm import curriculum

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(5, 2, 1)):
    """Targets by water filling, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def check(docs, got):
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = shares(sizes)
    taken, biggest = defaultdict(int), defaultdict(int)
    by_id = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
        biggest[source] = max(biggest[source], r.size)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= biggest[source]


def test_mix_of_the_small_table(sf_docs):
    got = curriculum.mixed(sf_docs).collect()
    assert len(got) == sf_docs.count()
    check(sf_docs, got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, curriculum.mixed(sf_docs.repartition(7)).collect()), key=repr)


@pytest.mark.parametrize("run", [4096, 8])
def test_odd_rows(docs_of, odd_rows, run, monkeypatch):
    monkeypatch.setattr(curriculum, "RUN", run)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_rows)]
    docs = docs_of(rows)
    check(docs, curriculum.mixed(docs).collect())


def test_null_ids_and_repeated_rows_are_counted(docs_of, odd_rows):
    got = curriculum.mixed(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)


def test_full_sources_pass_their_excess_on(docs_of):
    docs = docs_of([(1, "w " * 10, "a"), (2, "w " * 100, "b"), (3, "w " * 400, "c"), (4, "w " * 5, None)])
    got = {r.doc_id: r for r in curriculum.mixed(docs).collect()}
    target = shares({"a": 10, "b": 100, "c": 400, None: 5})
    assert got[1].target == 30 and got[4].target == 15
    assert [got[i].target for i in (1, 2, 3, 4)] == pytest.approx([target["a"], target["b"], target["c"], target[None]])


@pytest.mark.parametrize("knots", [((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.0), (0.4, 2.0), (1.0, 0.0))])
def test_inverse_of_the_integral(spark, knots):
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
    got = rows.select("share", curriculum.inverse_demand(F.col("share"), knots).alias("t")).collect()
    steps = 20_000
    area = [0.0]
    for i in range(steps):
        t = (i + 0.5) / steps
        (t0, w0), (t1, w1) = next((a, b) for a, b in zip(knots, knots[1:], strict=False) if t <= b[0])
        area.append(area[-1] + (w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / steps)
    for share, t in got:
        assert 0 <= t <= 1 and area[round(t * steps)] / area[-1] == pytest.approx(share, abs=1e-3)


def test_later_schedules_come_later(sf_docs):
    rows = curriculum.assign(curriculum.stage(curriculum.sized(sf_docs), "sizes")).select("place", F.explode("positions").alias("t"))
    mean = dict(rows.groupBy(F.col("place") % 3).agg(F.avg("t")).collect())
    assert mean[1] > mean[0] > mean[2]


def test_mix_repeats_rows_in_order(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(t or "")) for _, t, *_ in odd_rows)
    taken = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert abs(taken - words) <= 31_000


def test_only_built_in_functions(sf_docs):
    plan = curriculum.mixed(sf_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(docs_of):
    assert curriculum.mixed(docs_of([])).count() == 0 and curriculum.mix(docs_of([])).count() == 0

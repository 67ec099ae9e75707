import zlib

import numpy as np
import pytest

from tests.llm.conftest import SF
from visitlens.llm import gam


def test_additive_and_pairwise_parts_are_learnt():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (8000, len(gam.FEATURES)))
    single = (np.abs(x[:, 0]) > 0.5).astype(float)
    crossed = ((x[:, 1] > 0) == (x[:, 2] > 0)).astype(float)
    for y in (single, crossed):
        model = gam.fit(x[:6000], y[:6000])
        assert ((model.score(x[6000:]) > 0.5) == y[6000:]).mean() > 0.95
    assert (2, 1) in model.pairs


def test_scoring_is_table_lookup():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, len(gam.FEATURES)))
    model = gam.fit(x, (x[:, 0] > 0).astype(float))
    one = np.array([model.score(x[i : i + 1])[0] for i in range(50)])
    assert np.allclose(one, model.score(x)[:50])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in gam.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= gam.GOOD) for r in got.values())
    held = [(got[x.doc_id].predicted, x.quality) for x in labels.collect() if x.doc_id in got and got[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (sorted(map(tuple, gam.scored(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_other_columns_are_not_looked_at(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = sf_docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "-1L as n_chars", "1 as features", "2 as held_out")
    assert sorted(map(tuple, gam.scored(sf_docs, labels).collect())) == sorted(map(tuple, gam.scored(other, labels).collect()))


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (None, 1), (6, None), (100, 1)], "doc_id long, quality int")
    got = gam.scored(docs_of(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)} | {r.score for r in got if r.doc_id == 1}) <= 2


def test_without_labels_everything_stays(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert gam.good(docs_of(odd_rows), none).count() == len(odd_rows)
    assert gam.scored(docs_of([]), none).count() == 0


def test_filter_keeps_columns_and_the_accepted(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = gam.good(sf_docs, labels)
    assert kept.schema == sf_docs.schema
    good = {r.doc_id for r in gam.scored(sf_docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good


@pytest.mark.parametrize("text", ["", " ", "word", "a\nb\nb", "%%% !!!", "x" * 100_000])
def test_features_are_finite(text):
    assert np.isfinite(gam.features(text)).all() and len(gam.features(text)) == len(gam.FEATURES)

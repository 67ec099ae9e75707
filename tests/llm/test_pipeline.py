import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.llm.test_huffman import expected
from tests.llm.test_ngram_join import brute
from visitlens.llm import gam, spaced_seeds
from visitlens.llm.queries import QUERIES, tokenizer_path
from visitlens.llm.shared import attach, may_contain, row_key, stage, without


@pytest.fixture(scope="module")
def stages(spark, sf_docs):
    kept = [sf_docs]
    for _, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], SF), "test-stage").cache())
    return kept


def test_stages_keep_the_columns(stages, sf_docs):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(d.columns == sf_docs.columns for d in stages[:-1])


def test_decisions_take_effect(spark, stages):
    ids = [sorted(r.doc_id for r in d.collect()) for d in stages]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids[1] == sorted(r.doc_id for r in gam.scored(stages[0], labels).collect() if r.predicted)
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids[2] == sorted({c for _, _, c in brute(rows)})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[3] == sorted(r.doc_id for r in spaced_seeds.judged(stages[2], bench).collect() if not r.contaminated)
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 3


def test_tokens_of_the_last_stage(stages):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in stages[-2].collect()]
    assert sorted(map(tuple, stages[-1].collect()), key=lambda r: r[1]) == expected(rows, Tokenizer.from_file(tokenizer_path()))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_odd_rows_and_empty_tables(spark, docs_of, odd_rows, tmp_path):
    for name, rows in (("odd", odd_rows), ("empty", [])):
        folder = str(tmp_path / name)
        docs_of(rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").limit(len(rows)).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").limit(len(rows)).write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() >= len(rows) // 12


CLASHES = ("row_key", "maybe", "map_no", "map_at", "mix_row", "mix_position", "row", "row_no", "position", "positions", "size", "run", "label", "gid", "n", "hash", "anchor", "a.b")


def test_columns_of_the_caller_with_names_of_the_operators(spark, docs_of, odd_rows, tmp_path):
    """Filters keep such columns as they are; queries answer as without them."""
    folder = str(tmp_path / "clash")
    rows = [r for r in odd_rows if r[0] is not None][:30]
    docs = docs_of(rows)
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    more.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        got = function(spark, read, folder)
        assert got.columns == read.columns, name
        found = got.collect()
        assert found, name
        for r in found:
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES), name
    plain = str(tmp_path / "plain")
    docs.write.parquet(f"{plain}/documents.parquet")
    for name in ("op2_exact_dedup", "op3_curriculum", "op5_balanced_shards", "op6_near_duplicates", "op7_repeated_strings", "op10_personal_data", "op11_earlier_passages", "op13_divergence"):
        one, two = (sorted(map(repr, QUERIES[name](spark, at).collect())) for at in (folder, plain))
        assert one == two, name


@pytest.mark.parametrize("most", ["null", "7"])
def test_rows_without_a_key_and_of_a_heavy_key_are_spread(spark, most):
    rows = spark.range(20_000).selectExpr("id", f"if(id % 20 = 0, id % 50, {most}) as k")
    groups = stage(rows.filter("k is not null").groupBy("k").count(), "groups").withColumnRenamed("count", "n")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach(rows, groups, "k", "n", parts=200)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.filter("n is not null").count() == (1000 if most == "null" else 20_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 20_000 / 4


def test_filters_drop_only_what_is_listed(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    gone = stage(docs.filter("doc_id = 5 or doc_id is null").select(row_key().alias("row_key")), "gone")
    assert without(docs, gone).count() == sum(r[0] is not None and r[0] != 5 for r in odd_rows)
    keyed = docs.withColumn("row_key", row_key())
    assert may_contain(keyed, "row_key", gone, "row_key").filter("doc_id = 5 or doc_id is null").count() == 4

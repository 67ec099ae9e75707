"""A training corpus from raw documents: five stages, each on all that the one before kept.

Quality model, near copies, benchmark text, mix of sources, token files. Every stage is written as Parquet to the
shared folder and read again, so a lost executor costs one stage at most. The quality model is trained on rows of
``labels`` that are not held out; there is no SQL for it, so ``ORACLE_SQL`` is None and tests compare the stages
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm import curriculum, gam, huffman, ngram_join, spaced_seeds
from visitlens.llm.queries import documents, tokenizer_path
from visitlens.llm.shared import stage

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return gam.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text of the benchmark."""
    return spaced_seeds.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order."""
    return curriculum.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, written as coded files and read back: doc_id, start, n_tokens, ids_crc32."""
    return huffman.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("benchmark text", benchmark_text),
    ("mix", mix),
    ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return stage(STAGES[-1][1](spark, docs, sf_dir), "token-files")

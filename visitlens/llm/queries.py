"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm import curriculum, divergence, exact_dedup, gam, html_text, huffman, ngram_join, pii, prefix_trie, propagation, relative_lz, spaced_seeds, suffix_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as Huffman-coded files and read back."""
    return huffman.encode_and_read(documents(spark, sf_dir), tokenizer_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts and the row of each group that stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and the training position of its first copy."""
    return curriculum.mixed(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text."""
    return gam.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards with equal texts together."""
    return propagation.sharded(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the component of near copies that each belongs to."""
    return ngram_join.members(documents(spark, sf_dir)).drop("row_key")


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without strings of 200 bytes that occur twice."""
    return suffix_dedup.without_repeats(documents(spark, sf_dir)).drop("kept")


def op8_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold text of the benchmark, and of which items."""
    return spaced_seeds.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.personal_data(documents(spark, sf_dir))


def op11_earlier_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without windows of 20 words that occur earlier."""
    return relative_lz.without_repeats(documents(spark, sf_dir)).drop("kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt with shared first turns."""
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source most."""
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_curriculum": op3_curriculum,
    "op4_quality": op4_quality,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_visible_text": op8_visible_text,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_earlier_passages": op11_earlier_passages,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

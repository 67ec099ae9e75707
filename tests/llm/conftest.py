import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, dealt over a few partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null columns, empty and long texts, ties, repeated rows and a hot group."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None),
        (2, "", "a"),
        (3, "   \n\t ", "a"),
        (4, "one", "b"),
        (5, "one two three four five six seven", "b"),
        (5, "one two three four five six seven", "b"),
        (None, "one two three four five six seven", None),
        (None, None, None),
        (6, long, "c"),
        (7, long + " tail", "c"),
        (8, "ünïcode straße 日本語 \U0001f600 text ÉÈ", "ü"),
        (9, "a" * 1500, "z"),
    ]
    return rows + [(100 + i, "the hot text that many rows repeat word for word in full", "hot") for i in range(60)]


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

"""Where checkpoints and intermediate tables go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from visitlens.sources.upkeep import remove_folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    Both come from the configuration, and a cluster shares both.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh shared directory and read back, for what is read more than once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` staged for the length of a block. Unlike cached rows, it takes no memory of the executors."""
    path = shared_dir(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(df.sparkSession, path)

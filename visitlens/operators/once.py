"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column behind a generator.

    A filter on an ordinary derived column is pushed below it with the whole expression copied into
    every place the filter uses it; a generator's output is left where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))

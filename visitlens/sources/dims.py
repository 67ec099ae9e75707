"""Dimension sources: ban list, geo and network ranges, hosting networks, progress marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions import rules
from visitlens.operators.ranges import networks
from visitlens.schema import BAN

GEO_COLUMNS = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
ASN_COLUMNS = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("asn", T.IntegerType()),
        T.StructField("asn_org", T.StringType()),
    ]
)


def bans(decisions: DataFrame) -> DataFrame:
    """Distinct banned values; empty ones do not count."""
    return decisions.select("value").where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()


def read_bans(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of decisions. An empty file or array means no bans."""
    return bans(spark.read.schema(BAN).json(path, multiLine=True))


def _read_ranges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        table = spark.read.csv(path, header=True, schema=schema)
    else:
        table = spark.read.schema(schema).parquet(path)
    return networks(table)


def read_geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """CIDR blocks with country, city and coordinates, from CSV or Parquet."""
    return _read_ranges(spark, path, GEO_COLUMNS)


def read_asn_ranges(spark: SparkSession, path: str) -> DataFrame:
    """CIDR blocks with network number and owner, from CSV or Parquet."""
    return _read_ranges(spark, path, ASN_COLUMNS)


def datacenter_asns(spark: SparkSession, extra: dict[int, str] | None = None) -> DataFrame:
    """Known hosting networks; entries of ``extra`` win over the built-in ones."""
    known = {**rules.DATACENTER_ASNS, **(extra or {})}
    return spark.createDataFrame(list(known.items()), "asn int, provider string")


def last_mark(state: DataFrame) -> DataFrame:
    """Timestamp of the newest progress row."""
    return state.agg(F.max_by("last_processed_timestamp", "created_at").alias("last_processed_timestamp"))

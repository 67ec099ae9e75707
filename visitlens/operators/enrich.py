"""Geo, network-owner and provider columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.labels import provider_of
from visitlens.functions.requests import blank_to_null
from visitlens.operators.ranges import attach

GEO = ("country", "city", "latitude", "longitude")
ASN = ("asn", "asn_org")


def _geo_columns(prefer_header: bool) -> dict:
    # A blank name or a zero coordinate counts as missing.
    columns = {c: blank_to_null(F.col(f"_geo.{c}")) for c in ("country", "city")}
    columns |= {c: F.nullif(F.col(f"_geo.{c}"), F.lit(0.0)) for c in ("latitude", "longitude")}
    if prefer_header:
        columns["country"] = F.coalesce(F.col("header_country"), columns["country"])
    return columns


def _asn_columns(extra: dict[int, str] | None) -> dict:
    asn, org = F.col("_asn.asn"), F.col("_asn.asn_org")
    return {"asn": asn, "asn_org": org, "datacenter_provider": provider_of(asn, org, extra)}


def enrich_geo(df: DataFrame, geo: DataFrame, prefer_header: bool = False) -> DataFrame:
    """Adds country, city and coordinates of the client address.

    ``prefer_header`` lets a ``header_country`` column win over the table.
    """
    return attach(df, {"_geo": geo}).withColumns(_geo_columns(prefer_header)).drop("_geo")


def enrich_asn(df: DataFrame, networks: DataFrame, extra: dict[int, str] | None = None) -> DataFrame:
    """Adds network number, owner and hosting provider of the client address."""
    return attach(df, {"_asn": networks}).withColumns(_asn_columns(extra)).drop("_asn")


def enrich(
    df: DataFrame,
    geo: DataFrame,
    networks: DataFrame,
    extra: dict[int, str] | None = None,
    prefer_header: bool = False,
) -> DataFrame:
    """Both lookups over one list of distinct addresses and one join back to the events."""
    found = attach(df, {"_geo": geo, "_asn": networks})
    return found.withColumns({**_geo_columns(prefer_header), **_asn_columns(extra)}).drop("_geo", "_asn")


def datacenter_provider(df: DataFrame, extra: dict[int, str] | None = None) -> DataFrame:
    """Derives the provider from network columns already on the row."""
    return df.withColumn("datacenter_provider", provider_of("asn", "asn_org", extra))

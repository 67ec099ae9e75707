"""Search-intelligence reports.

Their producer is not part of what this library rebuilds; the formulas follow how the results are
shown. Searches have ``search_id, query_text, category, priority, search_date, has_ai_overview,
mentions_place, mentions_brand``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.metrics import count_where, fixed_round, percent, requests
from visitlens.plans.common import top


def search_overview(searches: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Totals of the overview cards in one row."""
    totals = searches.agg(
        requests("total_searches"),
        F.count_distinct("query_text").alias("queries_tracked"),
        count_where(F.col("has_ai_overview"), "ai_overviews_found"),
        count_where(F.col("mentions_place"), "place_mentions"),
        count_where(F.col("mentions_brand"), "brand_mentions"),
        F.min("search_date").alias("first_search_date"),
        F.max("search_date").alias("last_search_date"),
    )
    found = opportunities.agg(requests("platform_opportunities"))
    # Two single rows with disjoint columns, folded into one.
    rows = totals.unionByName(found, allowMissingColumns=True)
    row = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return row.withColumn("ai_overview_percentage", percent("ai_overviews_found", "total_searches", 1))


def search_queries(searches: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Searches, AI-overview rate and opportunities per query, with the chart band of the rate."""
    keys = ("query_text", "category", "priority")
    per_query = searches.groupBy(*keys).agg(
        requests("total_searches"),
        count_where(F.col("has_ai_overview"), "ai_overview_count"),
        F.max("search_date").alias("last_search"),
    )
    found = opportunities.groupBy("query_text").agg(requests("opportunity_count"))
    rate = percent("ai_overview_count", "total_searches", 0)
    return (
        per_query.join(found, "query_text", "left")
        .withColumn("opportunity_count", F.coalesce("opportunity_count", F.lit(0)))
        .withColumn("ai_percentage", rate)
        .withColumn(
            "band", F.when(F.col("ai_percentage") > 80, "high").when(F.col("ai_percentage") > 50, "medium").otherwise("low")
        )
    )


def ai_overviews(searches: DataFrame, citations: DataFrame, n: int = 5, shown: int = 5) -> DataFrame:
    """Newest AI overviews with their first citations; citations are read for those searches only."""
    newest = (
        searches.where("has_ai_overview")
        .select("search_id", "query_text", "search_date")
        .orderBy(F.col("search_date").desc(), "search_id")
        .limit(n)
    )
    cited = (
        citations.join(newest.select("search_id"), "search_id")
        .groupBy("search_id")
        .agg(
            requests("citation_count"),
            F.sort_array(F.collect_list(F.struct("position", "domain"))).alias("_all"),
        )
    )
    first = F.transform(F.slice("_all", 1, shown), lambda c: c["domain"])
    return (
        newest.join(cited, "search_id", "left")
        .withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))
        .withColumn("citations", first)
        .drop("_all")
        .orderBy(F.col("search_date").desc(), "search_id")
    )


def citations_by_domain(citations: DataFrame, organic: DataFrame, n: int = 20) -> DataFrame:
    """Most cited domains and whether and where they also rank organically."""
    cited = citations.groupBy("domain").agg(
        requests("citation_count"), fixed_round(F.avg("position"), 1).alias("avg_position")
    )
    ranked = organic.groupBy("domain").agg(fixed_round(F.avg("position"), 1).alias("avg_organic_position"))
    best = top(cited, "citation_count", ["domain"], n)
    joined = ranked.join(best, "domain", "right")
    return joined.withColumn("appears_in_organic", F.col("avg_organic_position").isNotNull())


def opportunities_by_status(opportunities: DataFrame, status: str = "new") -> DataFrame:
    return opportunities.where(F.col("status") == status)

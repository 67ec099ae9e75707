"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8). Every
query is run to the end with its result materialised; the session is warmed up once beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.catalog import QUERIES
from visitlens.session import build

HEADLINE = (
    "overall_stats",
    "filled_timeline_30d",
    "classification_breakdown",
    "top_bots",
    "geo_heatmap",
    "subnet_clusters",
    "time_bursts",
    "asn_analysis",
    "unique_ips",
    "geographic_clusters",
    "daily_stats",
    "class_distribution",
    "undetermined_overview",
    "undetermined_behaviour",
    "org_category_listing",
    "ip_verdicts",
    "sleepless_humans",
    "journeys",
    "behavior_patterns",
    "labels_from_flags",
    "labels_from_headers",
    "labels_with_sessions",
    "full_rerun",
    "human_patterns",
    "training_agents",
    "applied_changes",
    "geo_lookup",
    "network_lookup",
    "parsed_requests",
    "built_events",
    "routed_text",
)

SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str = sf_dir) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run(HEADLINE[0])
    seconds = {name: run(name) for name in HEADLINE}
    # The same queries on a tenth of the rows show how they scale.
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), SMALLER.get(os.path.basename(sf_dir.rstrip("/")), ""))
    small = round(sum(run(name, small_dir) for name in HEADLINE), 3) if os.path.basename(small_dir) else None
    result = {
        "metric": "total query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "smaller_total": small,
        "scaling": round(sum(seconds.values()) / small, 2) if small else None,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())

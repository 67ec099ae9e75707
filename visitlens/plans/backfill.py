"""Historical load: days of old logs into the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from visitlens.operators.filters import keep_sites, skip_loaded_days
from visitlens.settings import DEFAULT, Settings
from visitlens.sources.logs import parse_logs, read_logs_range
from visitlens.sources.sinks import append_events, to_backfilled
from visitlens.streaming.ingest import build_events
from visitlens.streaming.scratch import staged


def historical_events(
    spark: SparkSession,
    source: str,
    start: dt.date | str,
    end: dt.date | str,
    geo: DataFrame,
    networks: DataFrame,
    existing: DataFrame | None = None,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Events of the listed sites for whole days, in the stored layout.

    The country header wins over the geo table. Days that ``existing`` already holds are left out.
    """
    parsed = keep_sites(parse_logs(read_logs_range(spark, source, start, end), "backfill"), settings.listed_hosts)
    # Lines are parsed once: the list of addresses and the events themselves both come from the staged rows.
    new = to_backfilled(build_events(staged(parsed, "backfill"), geo, networks, prefer_header=True))
    return new if existing is None else skip_loaded_days(new, existing)


def backfill(
    spark: SparkSession, source: str, start, end, geo, networks, path: str, existing=None, load_id: int | None = None
) -> None:
    """Loads a range of days into the events table at ``path``; a load repeated under its id replaces itself."""
    append_events(historical_events(spark, source, start, end, geo, networks, existing), path, load_id)

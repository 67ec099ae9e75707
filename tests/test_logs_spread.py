"""Logs that the queries take in are written by many tasks, a batch each."""

from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pytest

from checks import catalog
from visitlens.sources import bindings as B

SF = "/root/testdata/sf0.001"


class Enough(Exception):
    pass


@pytest.mark.parametrize("name", ["late_ingestion", "pruned_ingestion", "compacted_days", "kept_dashboard", "ingested_session_labels"])
def test_a_log_has_several_files(spark, tmp_path, monkeypatch, name):
    def stop(*_):
        raise Enough

    monkeypatch.setattr(catalog, "_job", lambda *_, **__: SimpleNamespace(events_path=None))
    monkeypatch.setattr(catalog.G, "ingest_stream", stop)
    monkeypatch.setattr(catalog, "shared_dir", lambda *_: str(tmp_path))
    with pytest.raises(Enough):
        catalog.QUERIES[name](spark, SF)
    writes = Counter(p.name.split("-", 2)[2] for p in (tmp_path / "logs").glob("part-*"))
    assert len(writes) == 1 and min(writes.values()) > 1


def test_spread_events_are_the_web_events(spark):
    spread, web = B.spread_events(spark, SF), B.web_events(spark, SF)
    parts = spread.select("id").distinct().count(), spread.withColumn("p", catalog.F.spark_partition_id()).agg(catalog.F.countDistinct("p")).first()[0]
    assert parts == (web.select("id").distinct().count(), B.PARTS_A_CORE * spark.sparkContext.defaultParallelism)
    assert spread.exceptAll(web).isEmpty() and web.exceptAll(spread).isEmpty()

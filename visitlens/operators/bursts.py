"""The busiest moment of a key: most rows in any window of a fixed length, wherever it begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A chunk of time is this many windows long, so each row goes to 1.1 chunks on average.
CHUNK = 10


def peaks(events: DataFrame, seconds: float, key: str = "client_ip", ts: str = "timestamp") -> DataFrame:
    """Most rows of each key less than ``seconds`` apart (``peak``), and the last row of the first such window (``peak_at``).

    A key's time is cut into chunks, each with the rows of the last window before it, so windows over an edge are seen
    and a busy key is as many tasks as it has chunks. Rows without a key or a time have no window. Narrow rows are
    shuffled once by key and chunk; the counts per chunk combine on the map side.
    """
    width = int(seconds * 1_000_000)
    chunk = width * CHUNK
    at = F.col("_at")
    own = F.floor(at / F.lit(chunk))
    near_end = (own + 1) * chunk - at < width
    placed = (
        events.select(key, F.unix_micros(ts).alias("_at"))
        .where(F.col(key).isNotNull() & at.isNotNull())
        .withColumn("_own", own)
        .withColumn("_chunk", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    # A frame by range holds all rows of the same time.
    before = Window.partitionBy(key, "_chunk").orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = placed.withColumn("_n", F.count(F.lit(1)).over(before)).where("_own = _chunk")
    best = counted.groupBy(key).agg(F.max(F.struct(F.col("_n"), (-at).alias("_back"))).alias("_best"))
    return best.select(key, F.col("_best._n").alias("peak"), F.timestamp_micros(-F.col("_best._back")).alias("peak_at"))

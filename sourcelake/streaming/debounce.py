"""Debounced analysis requests as a stream: edits of a key less than a gap apart are one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, edits, analysed_at) of each burst, once the watermark has passed its end; works on a batch as well."""
    stamped = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    bursts = stamped.groupBy(F.session_window("at", gap), key).agg(F.count(F.lit(1)).alias("edits"), F.max("at").alias("analysed_at"))
    return bursts.select(key, "edits", "analysed_at")

"""The incremental flow as Structured Streaming: new codes only, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_new(stream: DataFrame, known: DataFrame, key: str, time: str | None = None, lateness: str = "7 days"):
    """Rows of a stream whose key isn't among the known ones, each key once.

    The anti join is against a static table; with an event-time column the
    memory of seen keys is bounded by the watermark.
    """
    fresh = stream.join(known.select(key).distinct(), key, "left_anti")
    if time is None:
        return fresh.dropDuplicates([key])
    return fresh.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def start(stream: DataFrame, path: str, checkpoint: str):
    """Write the appended rows as Parquet, all that is there now, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

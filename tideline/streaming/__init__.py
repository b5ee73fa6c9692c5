"""Structured Streaming: continuous upserts and windowed roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(engine, stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append each micro-batch to a keyed table; readers see the latest row of each key."""

    def write(batch: DataFrame, _: int) -> None:
        engine.tables.append(table, batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(stream: DataFrame, time: str, window: str, aggs: list[Column], by: list[str] | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per window since the epoch; rows later than ``lateness`` are left out."""
    grouped = stream.withWatermark(time, lateness).groupBy(F.window(time, window), *(by or []))
    return grouped.agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def sessions(stream: DataFrame, time: str, gap: str, aggs: list[Column], by: list[str] | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per session, which a gap without rows ends."""
    grouped = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), *(by or []))
    return grouped.agg(*aggs).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "*").drop("session_window")

"""Overlapping time chunks of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunk_totals(stream: DataFrame, size: str, step: str, lateness: str) -> DataFrame:
    """Count and sum per chunk and event type; a chunk closes ``lateness`` after its end."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", size, step).alias("chunk"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )

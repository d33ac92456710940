"""Ingest progress as a stream: per-window last events, and the state of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throttled(progress: DataFrame, window_ms: int = 100) -> DataFrame:
    """Last (bytes, at_ms) of each file in each window, for a stream of (run, rel, at_ms, bytes)."""
    at = F.timestamp_millis("at_ms")
    g = progress.withColumn("at", at).groupBy("run", "rel", F.window("at", f"{window_ms} milliseconds"))
    return g.agg(F.max(F.struct("at_ms", "bytes")).alias("last")).select("run", "rel", F.unix_millis("window.start").alias("slot_ms"), "last.at_ms", "last.bytes")


def file_states(progress: DataFrame) -> DataFrame:
    """Latest event of every file of every run, for (run, rel, seq, type, bytes)."""
    return progress.groupBy("run", "rel").agg(F.max(F.struct("seq", "type", "bytes")).alias("s")).select("run", "rel", F.col("s.type").alias("state"), F.col("s.bytes").alias("bytes"))

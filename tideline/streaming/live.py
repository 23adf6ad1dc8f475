"""Structured Streaming forms of the slot operators; watermarks need times with zone, so zone-free ones are cast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import rate_status


def live_rates(stream: DataFrame, *, ts: str = "ts", width: str = "1 second", late: str = "10 seconds", low: int = 5, high: int = 15) -> DataFrame:
    """Status of every slot that has rows, sent once no row of it can come any more."""
    counts = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("slot"), "n", rate_status(F.col("n"), low, high).alias("status"))


def live_sessions(stream: DataFrame, *, key: str, ts: str = "ts", gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of rows without a gap, per key, once they are over."""
    sessions = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

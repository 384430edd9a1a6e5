"""Photographs and measurements as they arrive: running counts by time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def by_window(rows: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour", cell: float = 10.0) -> DataFrame:
    """start, gx, gy, n, lo, hi of rows (time, x, y, v) by window and square, batch or stream; rows later than late are dropped from a stream."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    by = rows.groupBy(F.window(time, window).alias("w"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    return by.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.col("w.start").alias("start"), "gx", "gy", "n", "lo", "hi")


def start(rows: DataFrame, folder: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends each window to a Parquet folder once it is over."""
    return by_window(rows, **how).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)

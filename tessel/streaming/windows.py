"""Aggregates over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list[Column], slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Windows of one width, overlapping if ``slide`` is less; a stream drops what is later than ``delay``."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _late(df, ts, delay).groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], delay: str = "10 minutes") -> DataFrame:
    """Windows that end after a gap without events of the keys."""
    out = _late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])

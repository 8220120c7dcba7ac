"""Streams: candles of ticks with a watermark, and ticks without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, period: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    """Candles of a stream of symbol, ts, price, size and event_id, which orders equal times. A bar is final once the watermark has passed its
    end; ticks later than that are left out."""
    key = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", period), "symbol").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("symbol", F.unix_millis("window.start").alias("open_time"), "open", "high", "low", "close", "volume")


def without_repeats(ticks: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """The first tick of each key within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)

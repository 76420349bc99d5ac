"""Bars of a stream of ticks: the batch bars with a watermark for late ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, timeframe: str, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Bars of ticks (symbol, ts timestamp, seq, price, qty), final once the watermark has passed them.

    Ticks later than the watermark are dropped by Spark; a null quantity counts as 0.
    """
    order = F.struct("ts", "seq", "price")
    return (
        ticks.withWatermark("ts", lateness)
        .filter("symbol is not null and price is not null")
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(F.coalesce("qty", F.lit(0.0))).alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.unix_millis("w.start").alias("ts_ms"), "open", "high", "low", "close", "volume")
    )

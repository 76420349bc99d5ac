"""Quote volume of the last day at any past time, and the liquidity gate as of each signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bars import DAY_MS

BUCKET_MS = 300_000


def volume_buckets(ticks: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(symbol, ts_ms, quote_volume) of fixed stretches of time; ticks are summed before they are shuffled."""
    start = (F.floor(F.col("ts_us") / (bucket_ms * 1000)) * bucket_ms).cast("long")
    t = ticks.filter("symbol IS NOT NULL AND ts_us IS NOT NULL")
    return t.groupBy("symbol", start.alias("ts_ms")).agg(F.sum(F.col("price") * F.col("qty")).alias("quote_volume"))


def volume_at(times: DataFrame, buckets: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """(symbol, ts_ms, quote_volume) of distinct times: what the buckets that began in [ts_ms - window_ms, ts_ms) add up to; 0 if there is none.

    A symbol is sorted by slices of one window's width; a bucket also counts in the slice after its own, which
    is as far as a window reaches. So a hot symbol is as many tasks as it has slices.
    """
    asked = times.select("symbol", "ts_ms", F.lit(0.0).alias("_volume"), F.lit(True).alias("_asked"), F.array(F.floor(F.col("ts_ms") / window_ms)).alias("_slices"))
    own = F.floor(F.col("ts_ms") / window_ms)
    told = buckets.select("symbol", "ts_ms", F.coalesce("quote_volume", F.lit(0.0)).alias("_volume"), F.lit(False).alias("_asked"), F.array(own, own + 1).alias("_slices"))
    both = asked.unionAll(told).withColumn("_slice", F.explode("_slices"))
    window = f"(PARTITION BY symbol, _slice ORDER BY ts_ms RANGE BETWEEN {window_ms} PRECEDING AND 1 PRECEDING)"
    summed = both.selectExpr("symbol", "ts_ms", "_asked", f"coalesce(sum(_volume) OVER {window}, 0D) AS quote_volume")
    return summed.filter("_asked").groupBy("symbol", "ts_ms").agg(F.max("quote_volume").alias("quote_volume"))


def gated_at(found: DataFrame, ticks: DataFrame, min_quote_volume: float, window_ms: int = DAY_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The rows (symbol, ts_ms, ...) whose symbol traded enough in the window before them, with that quote_volume; equality passes."""
    volumes = volume_at(found.select("symbol", "ts_ms"), volume_buckets(ticks, bucket_ms), window_ms)
    return found.join(volumes, ["symbol", "ts_ms"]).filter(F.col("quote_volume") >= min_quote_volume)

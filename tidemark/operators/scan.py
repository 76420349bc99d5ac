"""The market scan: latest states of every eligible symbol on three timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FAST, TRADE, TREND, StateParams, Timeframe
from tidemark.operators.states import last_rows, with_states
from tidemark.sources.bars import latest_of_each, restricted


def latest_states(bars: DataFrame, symbols: DataFrame, frames: tuple[Timeframe, Timeframe, Timeframe] = (FAST, TRADE, TREND), p: StateParams = StateParams()) -> DataFrame:
    """One row per symbol of `symbols`: the latest states, and how many bars each timeframe had.

    Only bars of these symbols are made, sorted and cut. Indicators start at the first of the newest bars, as in a scan that
    fetches no more. All timeframes are one pass over one table.
    """
    fast, trade, trend = frames
    cut = latest_of_each(restricted(bars, symbols), {t.timeframe: t.candles for t in frames})
    gated = symbols.join(cut, "symbol", "left")  # a symbol without bars stays, with one empty row
    found = last_rows(with_states(gated, p, trade))
    at = lambda t, c: F.max(F.when(F.col("timeframe") == t.timeframe, F.col(c)))
    return found.groupBy(*symbols.columns).agg(
        at(trend, "trend").alias("trend"),
        at(trade, "direction").alias("direction"),
        at(fast, "momentum").alias("momentum"),
        at(trade, "atr_ok").alias("atr_ok"),
        at(trade, "vol_ok").alias("vol_ok"),
        at(trade, "atr").alias("atr"),
        F.coalesce(at(trade, "n"), F.lit(0)).alias("n_trade"),
    )


def _reason():
    return F.when(F.coalesce("n_trade", F.lit(0)) == 0, "no_15m_bars").when(F.col("atr").isNull(), "atr_history")


def scan_states(states: DataFrame) -> DataFrame:
    """All gated symbols whose states could be computed; no bars of the other timeframes leaves their neutral state."""
    return states.filter(_reason().isNull()).select(
        "symbol",
        F.coalesce("trend", F.lit("neutral")).alias("trend"),
        "direction",
        F.coalesce("momentum", F.lit("none")).alias("momentum"),
        "atr_ok",
        "vol_ok",
        "quote_volume",
    )


def scan_errors(states: DataFrame, unknown: DataFrame | None = None, faulty: DataFrame | None = None) -> DataFrame:
    """The symbols whose states could not be computed, and why; the others go on.

    unknown: symbols that the gate could not judge; faulty: (symbol, reason) of those with bad ticks (see sources.quality).
    """
    found = states.withColumn("reason", _reason()).filter("reason is not null").select("symbol", "reason")
    if unknown is not None:
        found = found.unionAll(unknown.select("symbol", F.lit("no_quote_volume")))
    return found if faulty is None else found.unionAll(faulty.select("symbol", "reason"))


def tradeable(states: DataFrame) -> DataFrame:
    """The symbols for which all five states agree on a long entry."""
    ok = (F.col("trend") == "bullish") & (F.col("direction") == "up") & (F.col("momentum") == "breakout_up") & F.col("atr_ok") & F.col("vol_ok")
    return states.filter(ok).select("symbol", "trend", "direction", "momentum", "quote_volume")


def write_scan(found: DataFrame, path: str) -> None:
    """What a scan has found, as one table; a later scan replaces it."""
    found.write.mode("overwrite").parquet(path)


def state_labels(states: DataFrame) -> DataFrame:
    """States as short labels, and one status line."""
    trend = F.when(F.col("trend") == "neutral", "neutral").otherwise(F.upper("trend"))
    momentum = F.when(F.col("momentum") == "breakout_up", "BO UP").when(F.col("momentum") == "breakout_down", "BO DOWN").otherwise("-")
    labelled = states.select("symbol", trend.alias("trend_label"), F.upper("direction").alias("direction_label"), momentum.alias("momentum_label"), "atr_ok", "vol_ok")
    line = F.concat_ws(" | ", "symbol", "trend_label", "direction_label", "momentum_label", F.col("atr_ok").cast("string"), F.col("vol_ok").cast("string"))
    return labelled.withColumn("status", line)

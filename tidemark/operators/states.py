"""States of a series at each bar: trend, direction, momentum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StateParams, Timeframe
from tidemark.functions.indicators import above_sql, along, atr_expanding_sql, blocked_series, overlap, volume_above_average_sql, with_indicators
from tidemark.functions.series import owned, split
from tidemark.sources.bars import KEY


def _expressions(p: StateParams, by: tuple[str, ...], row: str, trade: Timeframe | None) -> list[str]:
    w = along(by, row=row)
    before = f"lag(ema_slow, {p.slope_rows}) OVER {w}"
    strong = f"adx > {p.adx_min!r}D"
    out = [
        f"ema_slow - {before} AS ema_slope",
        # bullish or bearish where both averages, the slow one's slope and ADX agree; else, or with too short a history, neutral
        f"CASE WHEN rn + 1 < {p.slow + p.slope_rows} THEN 'neutral' WHEN {above_sql('ema_fast', 'ema_slow')} AND {above_sql('ema_slow', before)} AND {strong} THEN 'bullish'"
        f" WHEN {above_sql('ema_slow', 'ema_fast')} AND {above_sql(before, 'ema_slow')} AND {strong} THEN 'bearish' ELSE 'neutral' END AS trend",
        f"CASE WHEN rn + 1 < {p.slow} THEN 'range' WHEN {above_sql('ema_fast', 'ema_slow')} THEN 'up' WHEN {above_sql('ema_slow', 'ema_fast')} THEN 'down' ELSE 'range' END AS direction",
        # whether the close left the range of the bar before
        f"CASE WHEN close > lag(high) OVER {w} THEN 'breakout_up' WHEN close < lag(low) OVER {w} THEN 'breakout_down' ELSE 'none' END AS momentum",
    ]
    if trade is not None:
        out += [f"{atr_expanding_sql(trade.atr_expansion, trade.atr_period, by, row)} AS atr_ok", f"{volume_above_average_sql(trade.volume_lookback, by, row)} AS vol_ok"]
    return out


def with_states(bars: DataFrame, p: StateParams = StateParams(), trade: Timeframe | None = None) -> DataFrame:
    """Adds the indicators, ema_slope and the three states to every bar; atr_ok and vol_ok by the settings of `trade`, if given."""
    b = with_indicators(blocked_series(bars), p)
    return b.selectExpr(*(c for c in b.columns if c not in ("_blk", "_place")), *_expressions(p, KEY, "rn", trade))


def long_states(bars: DataFrame, p: StateParams = StateParams(), trade: Timeframe | None = None, rows: int = 16_384, before: int | None = None) -> DataFrame:
    """`with_states` of series of any length: no task sorts a whole one.

    Series are numbered by chunks of time and cut into parts of `rows` rows. Each part is computed on its own, with
    the `before` rows that its averages still remember in front of it.
    """
    by = (*KEY, "_part")
    parts = split(bars, rows, overlap(p) if before is None else before)
    b = with_indicators(blocked_series(parts, by, "_row"), p, by, "_row")
    inner = ("_part", "_blk", "_place", "_row", "_own")
    b = b.selectExpr(*(c for c in b.columns if c not in inner), *_expressions(p, by, "_row", trade), "_own")
    return owned(b)


def last_rows(df: DataFrame) -> DataFrame:
    """The newest row of each series, with the series' length as `n`."""
    w = Window.partitionBy(*KEY)
    return df.withColumn("n", F.count("*").over(w)).filter(F.col("rn") == F.col("n") - 1)


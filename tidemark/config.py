"""Parameters of the scan and of signal evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Timeframe:
    timeframe: str
    ms: int
    candles: int
    atr_period: int
    atr_expansion: float
    volume_lookback: int
    min_quote_volume: int


# The three timeframes and their settings.
FAST = Timeframe("5m", 300_000, 100, 14, 1.05, 20, 5_000_000)
TRADE = Timeframe("15m", 900_000, 100, 14, 1.03, 20, 10_000_000)
TREND = Timeframe("1h", 3_600_000, 200, 14, 1.02, 24, 20_000_000)
TIMEFRAMES = (FAST, TRADE, TREND)


@dataclass(frozen=True)
class StateParams:
    """Spans and thresholds of the trend, direction and momentum states."""

    fast: int = 20
    slow: int = 50
    period: int = 14
    adx_min: float = 15.0
    slope_rows: int = 3


@dataclass(frozen=True)
class BarrierParams:
    """Multiples of the average true range, fees in percent, and look-ahead in bars."""

    warmup: int = 200
    lookahead: int = 2
    stop: float = 2.0
    target: float = 1.15
    target_short: float = 1.3
    min_target_pct: float = 0.30
    taker_fee: float = 0.04
    funding_fee: float = 0.0
    include_entry_bar: bool = False
    keep_unresolved: bool = False

    @property
    def fees(self) -> float:
        return 2 * self.taker_fee + self.funding_fee


def timeframe_config(spark: SparkSession) -> DataFrame:
    """The settings as a table of three rows, to be joined by timeframe."""
    rows = [(t.timeframe, t.candles, t.atr_period, t.atr_expansion, t.volume_lookback, t.min_quote_volume) for t in TIMEFRAMES]
    return spark.createDataFrame(rows, "timeframe string, candles int, atr_period int, atr_expansion double, volume_lookback int, min_quote_volume long")

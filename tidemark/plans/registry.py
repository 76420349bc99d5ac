"""The registered candle queries: names and callables. Their SQL is in `oracle`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FAST, TIMEFRAMES, TRADE, TREND, BarrierParams, Timeframe, timeframe_config
from tidemark.functions import indicators as ind
from tidemark.operators import metrics as met
from tidemark.operators import resume, scan, signals
from tidemark.operators.states import last_rows, long_states, with_states
from tidemark.plans import oracle
from tidemark.sources import bars as src
from tidemark.sources import quality, volume
from tidemark.sources.stored import shared_dir, written

#: Quote volume a day that lets some of the event types pass and some not.
MIN_QUOTE_VOLUME = oracle.MIN_QUOTE_VOLUME
DAILY = Timeframe("1d", src.DAY_MS, 100, 14, 1.03, 20, 0)
WEEKLY = Timeframe("7d", 7 * src.DAY_MS, 200, 14, 1.02, 24, 0)


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return src.event_ticks(spark, d)


def _bars(spark: SparkSession, d: str, t: Timeframe) -> DataFrame:
    return src.resample(_ticks(spark, d), t.timeframe, t.ms)


def _all_bars(spark: SparkSession, d: str) -> DataFrame:
    return src.resample_all(_ticks(spark, d), TIMEFRAMES)


def _states(spark: SparkSession, d: str) -> DataFrame:
    return with_states(_all_bars(spark, d))


def _trade_states(spark: SparkSession, d: str) -> DataFrame:
    return with_states(_bars(spark, d, TRADE))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", "ts_ms", *(F.round(c, 6).alias(c) for c in columns))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return src.liquid(src.universe(src.event_markets(spark, d)), src.tickers(_ticks(spark, d)), MIN_QUOTE_VOLUME)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return scan.latest_states(_all_bars(spark, d), _gated(spark, d))


def _scan_states(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_states(_scanned(spark, d)).withColumn("quote_volume", F.round("quote_volume", 4))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return signals.aligned_states(_states(spark, d))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.signals(signals.with_next_bars(_aligned(spark, d)))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return signals.evaluate(_states(spark, d))


def _price_digits(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("entry", "exit_price")})


def _supplier_bars(spark: SparkSession, d: str) -> DataFrame:
    daily = src.resample(src.lineitem_ticks(spark, d), DAILY.timeframe, DAILY.ms)
    return daily.unionAll(src.rebase(daily, WEEKLY.timeframe, WEEKLY.ms))


def _universe_bars(ticks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Daily bars of the universe alone. The gate is made of ticks and so too large, by its estimate, to be broadcast: ticks are
    shuffled to meet it. The market list is a small table, which leaves out the others' ticks before that."""
    return src.restricted(src.resample(ticks, DAILY.timeframe, DAILY.ms), symbols)


def _supplier_scanned(spark: SparkSession, d: str, as_of: int | None = None) -> DataFrame:
    ticks, symbols = src.lineitem_ticks(spark, d, until_ms=as_of), src.universe(src.supplier_markets(spark, d))
    gated = src.liquid(symbols, src.tickers(ticks, 365 * src.DAY_MS), 0)
    daily = _universe_bars(ticks, symbols)
    return scan.latest_states(daily.unionAll(src.rebase(daily, WEEKLY.timeframe, WEEKLY.ms)), gated, (DAILY, DAILY, WEEKLY))


def _supplier_scan(spark: SparkSession, d: str, as_of: int | None = None) -> DataFrame:
    return scan.scan_states(_supplier_scanned(spark, d, as_of)).withColumn("quote_volume", F.round("quote_volume", 4))


def _supplier_errors(spark: SparkSession, d: str) -> DataFrame:
    """A scan so early that some suppliers have too few bars, and some no trade in the ticker's window of a day."""
    ticks = src.lineitem_ticks(spark, d, until_ms=oracle.EARLY)
    symbols, tickers = src.universe(src.supplier_markets(spark, d)), src.tickers(ticks, oracle.EARLY_WINDOW)
    daily = _universe_bars(ticks, symbols)
    states = scan.latest_states(daily.unionAll(src.rebase(daily, WEEKLY.timeframe, WEEKLY.ms)), src.liquid(symbols, tickers, 0), (DAILY, DAILY, WEEKLY))
    return scan.scan_errors(states, src.unknown_volume(symbols, tickers))


def _read_by_timeframe(spark: SparkSession, d: str) -> DataFrame:
    """The newest bars of every series, by each timeframe's own number of candles."""
    return src.latest_of_each(src.unique_bars(_all_bars(spark, d)), {t.timeframe: t.candles for t in TIMEFRAMES}).select("symbol", "timeframe", "ts_ms", "open", "high", "low", "close", "volume")


def _recent_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades of an evaluation of the last days, which reads no more history than it needs."""
    return signals.evaluate(with_states(src.history(_all_bars(spark, d), TIMEFRAMES, oracle.DAYS)))


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """States of the bars after a time, from the bars after it and what is kept of those before."""
    bars = _all_bars(spark, d)
    held = written(resume.tail(with_states(bars.filter(F.col("ts_ms") < oracle.CUT))), "held")
    return resume.resumed_states(held, bars.filter(F.col("ts_ms") >= oracle.CUT), trade=TRADE)


def _merged_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of two loads, the ticks of odd and of even numbers, merged."""
    loads = [_ticks(spark, d).filter(F.col("seq.event_id") % 2 == k) for k in (1, 0)]
    return src.finished(src.merged(*(src.bar_states(t, TRADE.timeframe, TRADE.ms) for t in loads)))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The ticks as a bad feed delivers them: fields missing by their number, the first hours of January 2nd twice."""
    t, n = _ticks(spark, d), F.col("seq.event_id")
    bad = t.select(
        F.when(n % 211 != 0, F.col("symbol")).alias("symbol"),
        F.when(n % 307 != 0, F.col("ts_us")).alias("ts_us"),
        "seq",
        F.when((F.col("symbol") != "error") | (n % 7 != 0), F.when(n % 401 == 0, -F.col("price")).otherwise(F.col("price"))).alias("price"),
        "qty",
    )
    again = t.filter(F.col("ts_us").between(oracle.AGAIN[0] * 1000, oracle.AGAIN[1] * 1000 - 1))
    return bad.unionByName(again)


def _store(spark: SparkSession, d: str) -> str:
    """Where the bars of all timeframes are stored, by timeframe and day; the second load delivers the later days again."""
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    bars = _all_bars(spark, d)
    src.write_bars(bars, path)
    src.write_bars(bars.filter(F.col("ts_ms") >= oracle.CUT), path)
    return path


def _stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of one timeframe and some days, read from the store."""
    return src.read_bars(spark, _store(spark, d), TRADE.timeframe, as_of_ms=oracle.CUT, since_ms=oracle.AGAIN[0])


def _stored_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan of stored bars, of which only those of the gated symbols are sorted and cut."""
    states = scan.latest_states(src.read_bars(spark, _store(spark, d)), _gated(spark, d))
    return scan.scan_states(states).withColumn("quote_volume", F.round("quote_volume", 4))


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """Bars as a source delivers them that repeats the last day."""
    bars = _all_bars(spark, d)
    return bars.unionAll(bars.filter(F.col("ts_ms") >= oracle.CUT))


def _gated_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals whose symbol traded enough in the day before them."""
    return volume.gated_at(_signals(spark, d), _ticks(spark, d), MIN_QUOTE_VOLUME)


def _long_states(spark: SparkSession, d: str) -> DataFrame:
    """States of all three timeframes, each series in parts."""
    return long_states(_all_bars(spark, d), trade=TRADE, rows=oracle.PART_ROWS)


def _far_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades that may stay open for a week, of series in parts."""
    p = BarrierParams(lookahead=oracle.FAR)
    return signals.evaluate(_long_states(spark, d), p, rows=oracle.PART_ROWS, slice_ms=5 * src.DAY_MS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars_5m": lambda s, d: _bars(s, d, FAST),
    "bars_15m": lambda s, d: _bars(s, d, TRADE),
    "bars_1h": lambda s, d: _bars(s, d, TREND),
    "latest_n_bars": _read_by_timeframe,
    "config_join": lambda s, d: _all_bars(s, d).groupBy("timeframe").agg(F.count("*").alias("n_bars")).join(F.broadcast(timeframe_config(s)), "timeframe"),
    "universe": lambda s, d: src.universe(src.event_markets(s, d)),
    "liquid_universe": lambda s, d: _gated(s, d).withColumn("quote_volume", F.round("quote_volume", 4)),
    "ema_20_50": lambda s, d: _rounded(_trade_states(s, d), "ema_fast", "ema_slow"),
    "true_range": lambda s, d: _rounded(ind.numbered(_bars(s, d, TRADE)).withColumn("tr", ind.true_range()), "tr"),
    "atr_14": lambda s, d: _rounded(_trade_states(s, d), "atr"),
    "directional_movement": lambda s, d: _rounded(ind.directional_movement(_bars(s, d, TRADE)), "plus_dm", "minus_dm"),
    "adx_14": lambda s, d: _rounded(_trade_states(s, d), "adx"),
    "ema_slope": lambda s, d: _rounded(_trade_states(s, d), "ema_slope"),
    "trend_bias": lambda s, d: _states(s, d).filter(F.col("timeframe") == TREND.timeframe).select("symbol", "ts_ms", "trend"),
    "trade_direction": lambda s, d: _trade_states(s, d).select("symbol", "ts_ms", "direction"),
    "momentum": lambda s, d: with_states(_bars(s, d, FAST)).select("symbol", "ts_ms", "momentum"),
    "latest_momentum": lambda s, d: last_rows(with_states(_bars(s, d, FAST))).select("symbol", "ts_ms", "momentum", F.col("n").alias("n_bars")),
    "atr_expanding": lambda s, d: _trade_states(s, d).select("symbol", "ts_ms", ind.atr_expanding(TRADE.atr_expansion, TRADE.atr_period).alias("atr_ok")),
    "volume_above_avg": lambda s, d: _trade_states(s, d).select("symbol", "ts_ms", ind.volume_above_average(TRADE.volume_lookback).alias("vol_ok")),
    "scan_states": _scan_states,
    "scan_tradeable": lambda s, d: scan.tradeable(_scan_states(s, d)),
    "scan_hit_count": lambda s, d: scan.tradeable(_scan_states(s, d)).agg(F.count("*").alias("hits")),
    "scan_errors": lambda s, d: scan.scan_errors(_scanned(s, d)),
    "state_labels": lambda s, d: scan.state_labels(_scan_states(s, d)),
    "asof_states": lambda s, d: _aligned(s, d).select("symbol", "ts_ms", "trend", "direction", "momentum"),
    "signals": lambda s, d: _signals(s, d).select("symbol", "side", "ts_ms", "entry_ts", F.round("entry", 6).alias("entry"), F.round("atr", 6).alias("atr")),
    "forward_bars": lambda s, d: _signals(s, d).select("symbol", "ts_ms", F.posexplode("ahead").alias("k", "bar")).select("symbol", "ts_ms", F.col("k").cast("long").alias("k"), F.col("bar.ts_ms").alias("bar_ts"), "bar.high", "bar.low"),
    "first_touch": lambda s, d: signals.first_touch(_signals(s, d)).select("symbol", "side", "entry_ts", "exit_ts", "exit_reason", *(F.round(c, 6).alias(c) for c in ("sl", "tp", "exit_price"))),
    "trades": lambda s, d: _price_digits(_trades(s, d)),
    "equity_curve": lambda s, d: met.equity_curve(_trades(s, d)).select("grp", "symbol", "entry_ts", "pnl", *(F.round(c, 6).alias(c) for c in ("equity", "peak", "drawdown"))),
    "metrics_by_side": lambda s, d: met.metrics(_trades(s, d)),
    "metrics_empty": lambda s, d: met.metrics(_trades(s, d).filter("side = 'NEITHER'")),
    "metrics_report": lambda s, d: met.metrics_report(met.metrics(_trades(s, d))),
    "trade_report": lambda s, d: _price_digits(met.trade_report(_trades(s, d))),
    "supplier_bars": lambda s, d: _supplier_bars(s, d).select("symbol", "timeframe", "ts_ms", "open", "high", "low", "close", "volume"),
    "supplier_scan_states": _supplier_scan,
    "supplier_scan_tradeable": lambda s, d: scan.tradeable(_supplier_scan(s, d, oracle.BUSY)),
    "supplier_scan_hit_count": lambda s, d: scan.tradeable(_supplier_scan(s, d, oracle.BUSY)).agg(F.count("*").alias("hits")),
    "supplier_scan_errors": _supplier_errors,
    "recent_trades": lambda s, d: _price_digits(_recent_trades(s, d)),
    "long_series_states": lambda s, d: _long_states(s, d).select("symbol", "timeframe", "ts_ms", "rn", *(F.round(c, 6).alias(c) for c in ("ema_fast", "ema_slow", "atr", "adx")), "trend", "direction", "momentum", "atr_ok", "vol_ok"),
    "resumed_states": lambda s, d: _resumed(s, d).select("symbol", "timeframe", "ts_ms", *(F.round(c, 6).alias(c) for c in ("ema_fast", "ema_slow", "atr", "adx")), "trend", "direction", "momentum", "atr_ok", "vol_ok"),
    "gated_signals": lambda s, d: _gated_signals(s, d).select("symbol", "side", "ts_ms", "entry_ts", F.round("quote_volume", 4).alias("quote_volume")),
    "merged_bars": _merged_bars,
    "stored_bars": lambda s, d: _stored_bars(s, d).select("symbol", "timeframe", "ts_ms", "open", "high", "low", "close", "volume"),
    "stored_scan_states": _stored_scan,
    "repeated_bars": lambda s, d: src.repeated_bars(_delivered(s, d)),
    "feed_faults": lambda s, d: quality.fault_counts(quality.judged(_feed(s, d))),
    "feed_errors": lambda s, d: quality.faulty_symbols(quality.judged(_feed(s, d))),
    "feed_bars": lambda s, d: src.resample(quality.good(quality.judged(_feed(s, d))), TREND.timeframe, TREND.ms),
    "far_trades": lambda s, d: _price_digits(_far_trades(s, d)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.queries()

"""Signals of every bar of a history, and their resolution on the bars that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TRADE, TREND, BarrierParams
from tidemark.functions.series import owned, split
from tidemark.operators.asof import asof_join_all
from tidemark.operators.touch import first_touches
from tidemark.sources.bars import DAY_MS, KEY
from tidemark.sources.stored import replace_days


#: The most bars ahead that are taken into a bar's row; a longer look-ahead is searched through an index.
NEAR = 16


def aligned_states(states: DataFrame, fast: str = "5m", trade: str = "15m", trend: str = "1h", visibility: str = "open", trend_ms: int = TREND.ms, fast_ms: int = 300_000, slice_ms: int | None = 90 * DAY_MS) -> DataFrame:
    """The trade timeframe's bars with the trend and the momentum as of each bar's time.

    visibility "open" matches bars by their start; "close" lets a bar count only once it is complete. A symbol is sorted
    by slices of slice_ms.
    """
    if visibility not in ("open", "close"):
        raise ValueError("visibility is open or close")
    shift = (lambda ms: 0) if visibility == "open" else (lambda ms: ms)
    base = states.filter(F.col("timeframe") == trade).drop("trend", "momentum")
    slow = states.filter(F.col("timeframe") == trend).select("symbol", (F.col("ts_ms") + shift(trend_ms)).alias("ts_ms"), "trend")
    quick = states.filter(F.col("timeframe") == fast).select("symbol", (F.col("ts_ms") + shift(fast_ms)).alias("ts_ms"), "momentum")
    return asof_join_all(base, [(slow, {"trend": "neutral"}), (quick, {"momentum": "none"})], "symbol", "ts_ms", slice_ms)


def with_next_bars(aligned: DataFrame, p: BarrierParams = BarrierParams(), rows: int | None = None) -> DataFrame:
    """Adds entry_ts, entry (the next bar's open) and, unless the look-ahead is longer than NEAR, `ahead`, the bars that can resolve a signal, in order.

    rows: sort series in parts of so many rows, which hold the bars ahead of their last one; bars then need their number rn.
    """
    by, parts = KEY, aligned
    if rows is not None:
        by, parts = (*KEY, "_part"), split(aligned, rows, 0, after=1 + p.lookahead)
    w = f"(PARTITION BY {', '.join(by)} ORDER BY ts_ms)"
    added = [f"lead(ts_ms) OVER {w} AS entry_ts", f"lead(open) OVER {w} AS entry"]
    if p.lookahead <= NEAR:
        bars = (f"lead(struct(ts_ms, high, low), {k}) OVER {w}" for k in range(first_ahead(p), 2 + p.lookahead))
        added.append(f"filter(array({', '.join(bars)}), x -> x IS NOT NULL) AS ahead")
    found = parts.selectExpr(*aligned.columns, *added, *(["_own"] if rows is not None else []))
    return found if rows is None else owned(found)


def first_ahead(p: BarrierParams) -> int:
    """How many bars after a signal's bar the first one lies that can resolve it."""
    return 1 if p.include_entry_bar else 2


def signals(bars: DataFrame, p: BarrierParams = BarrierParams()) -> DataFrame:
    """LONG and SHORT signals of with_next_bars()'s rows; each bar stands for itself, so trades may overlap."""
    long = (F.col("trend") == "bullish") & (F.col("direction") == "up") & F.col("momentum").isin("impulse_up", "breakout_up")
    short = (F.col("trend") == "bearish") & (F.col("direction") == "down") & (F.col("momentum") != "breakout_up")
    side = F.when(long, "LONG").when(short, "SHORT")
    expected = F.try_divide(F.col("atr") * p.target, F.col("entry")) * 100
    eligible = (F.col("rn") >= p.warmup) & F.col("entry_ts").isNotNull() & F.col("atr").isNotNull() & ~F.isnan("atr")
    found = bars.withColumn("side", side).filter(F.col("side").isNotNull() & eligible)
    return found.filter((F.col("side") == "SHORT") | (expected >= p.min_target_pct))


def _barriers(found: DataFrame, p: BarrierParams) -> DataFrame:
    up, down = f"entry + {p.stop!r}D * atr", f"entry - {p.stop!r}D * atr"
    goal, low_goal = f"entry + {p.target!r}D * atr", f"entry - {p.target_short!r}D * atr"
    return found.selectExpr("*", f"CASE WHEN side = 'LONG' THEN {down} ELSE {up} END AS sl", f"CASE WHEN side = 'LONG' THEN {goal} ELSE {low_goal} END AS tp")


def _reason(low: str, high: str) -> str:
    """Which barrier a bar touches; within a bar the stop comes first."""
    stop, target = f"CASE WHEN side = 'LONG' THEN {low} <= sl ELSE {high} >= sl END", f"CASE WHEN side = 'LONG' THEN {high} >= tp ELSE {low} <= tp END"
    return f"CASE WHEN {stop} THEN 'SL' WHEN {target} THEN 'TP' END"


def _resolved(touched: DataFrame, columns: list[str]) -> DataFrame:
    price = "CASE _touch.reason WHEN 'SL' THEN sl WHEN 'TP' THEN tp END AS exit_price"
    return touched.selectExpr(*columns, "sl", "tp", "_touch.ts_ms AS exit_ts", price, "_touch.reason AS exit_reason")


def first_touch(found: DataFrame, p: BarrierParams = BarrierParams()) -> DataFrame:
    """Adds sl, tp, exit_ts, exit_price and exit_reason, null where no bar of `ahead` touches a barrier."""
    bars = f"transform(ahead, b -> named_struct('ts_ms', b.ts_ms, 'reason', {_reason('b.low', 'b.high')}))"
    touched = _barriers(found, p).selectExpr("*", f"try_element_at(filter({bars}, x -> x.reason IS NOT NULL), 1) AS _touch")
    return _resolved(touched, found.columns)


def first_touch_far(found: DataFrame, bars: DataFrame, p: BarrierParams) -> DataFrame:
    """`first_touch` for a look-ahead of any length, among the trade timeframe's numbered bars."""
    barred = _barriers(found, p)
    touches = first_touches(barred, bars, p.lookahead, first_ahead(p))
    joined = barred.join(touches, ["symbol", "rn"], "left")
    reason = f"CASE WHEN touch IS NOT NULL THEN named_struct('ts_ms', touch.ts_ms, 'reason', {_reason('touch.low', 'touch.high')}) END AS _touch"
    return _resolved(joined.selectExpr("*", reason), found.columns)


TRADE_COLUMNS = "side entry_ts exit_ts entry exit_price pnl pnl_gross fees exit_reason sl_pct tp_pct sl tp".split()


def trades(touched: DataFrame, p: BarrierParams = BarrierParams()) -> DataFrame:
    """Trade records; unresolved signals make none unless asked for. Net profit is rounded from the unrounded gross."""
    entry, leave = F.col("entry"), F.col("exit_price")
    gross = F.try_divide(F.when(F.col("side") == "LONG", leave - entry).otherwise(entry - leave), entry) * 100
    away = lambda x: F.round(F.abs(F.try_divide(entry - F.col(x), entry) * 100), 3)
    made = touched if p.keep_unresolved else touched.filter(F.col("exit_reason").isNotNull())
    made = made.select("symbol", "side", "entry_ts", "exit_ts", "entry", "exit_price", F.round(gross - p.fees, 3).alias("pnl"), F.round(gross, 3).alias("pnl_gross"), F.round(F.lit(p.fees), 3).alias("fees"), "exit_reason", away("sl").alias("sl_pct"), away("tp").alias("tp_pct"), F.round(F.abs("sl"), 3).alias("sl"), F.round("tp", 3).alias("tp"))
    return made.select("symbol", *TRADE_COLUMNS)


def evaluate(states: DataFrame, p: BarrierParams = BarrierParams(), rows: int | None = None, **alignment) -> DataFrame:
    """All trades of a history of states. rows: see with_next_bars."""
    found = signals(with_next_bars(aligned_states(states, trade=TRADE.timeframe, **alignment), p, rows), p)
    if p.lookahead <= NEAR:
        return trades(first_touch(found, p), p)
    return trades(first_touch_far(found, states.filter(F.col("timeframe") == TRADE.timeframe), p), p)


def write_trades(made: DataFrame, path: str, files: int = 8) -> None:
    """Stores trades by day of entry; the days among them are replaced, so an evaluation can be repeated."""
    replace_days(made, path, "entry_ts", (), files)

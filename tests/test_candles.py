"""Units of the candle engine on hand-made bars and trades."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import FAST, TRADE, TREND, BarrierParams
from tidemark.functions.indicators import atr_expanding, volume_above_average, with_indicators
from tidemark.functions.recurrence import recurrences, seeded
from tidemark.operators import metrics as met
from tidemark.operators import scan, signals
from tidemark.operators.asof import asof_join
from tidemark.operators.states import last_rows, with_states
from tidemark.sources import bars as src

MIN = 60_000


def series(spark, closes, symbol="A", timeframe="15m", spread=1.0, volume=10.0, step=15 * MIN):
    rows = [(symbol, timeframe, k * step, float(c), float(c) + spread, float(c) - spread, float(c), float(volume)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.BAR)


def at_end(df):
    return last_rows(df).first()


def test_momentum_compares_with_the_bar_before(spark):
    for closes, want in (([10], "none"), ([10, 11], "none"), ([10, 11.01], "breakout_up"), ([10, 9], "none"), ([10, 8.99], "breakout_down")):
        assert at_end(with_states(series(spark, closes))).momentum == want


def test_direction_and_trend_need_history(spark):
    for n, way, bias in ((49, "range", "neutral"), (50, "up", "neutral"), (52, "up", "neutral"), (53, "up", "bullish")):
        row = at_end(with_states(series(spark, range(100, 100 + n))))
        assert (row.direction, row.trend) == (way, bias)
    row = at_end(with_states(series(spark, range(300, 200, -1))))
    assert (row.direction, row.trend) == ("down", "bearish")


@pytest.mark.parametrize("price", [100.0, 0.1])
def test_flat_series_is_neutral_without_nan(spark, price):
    df = with_states(series(spark, [price] * 60, spread=0.0, volume=3.3)).select("*", atr_expanding(1.03, 14).alias("atr_ok"), volume_above_average(20).alias("vol_ok"))
    assert df.filter("direction <> 'range' or trend <> 'neutral' or atr_ok or vol_ok or isnan(adx) or isnan(atr)").count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_recurrence_equals_a_loop(spark, block):
    r = random.Random(1)
    xs = [r.uniform(1, 9) for _ in range(700)]
    df = spark.createDataFrame([("A", k, x) for k, x in enumerate(xs)], "s string, rn long, x double")
    out = recurrences(df, {"y": (seeded(F.col("x"), F.col("x"), 2, 0.1), 0.1)}, ("s",), block=block).orderBy("rn").collect()
    y = 0.0
    for k, row in enumerate(out):
        y = 0.0 if k < 2 else xs[k] if k == 2 else 0.9 * y + 0.1 * xs[k]
        assert math.isclose(row.y, y, rel_tol=1e-12, abs_tol=1e-12)


def test_indicators_follow_wilder(spark):
    r = random.Random(2)
    closes = [100 + r.uniform(-3, 3) for _ in range(80)]
    out = with_indicators(series(spark, closes)).orderBy("ts_ms").collect()
    high, low = [c + 1 for c in closes], [c - 1 for c in closes]
    tr = [high[0] - low[0]] + [max(high[k] - low[k], abs(high[k] - closes[k - 1]), abs(low[k] - closes[k - 1])) for k in range(1, 80)]
    atr = sum(tr[:14]) / 14
    assert out[12].atr is None and math.isclose(out[13].atr, atr, rel_tol=1e-12)
    for k in range(14, 80):
        atr = (13 * atr + tr[k]) / 14
        assert math.isclose(out[k].atr, atr, rel_tol=1e-11)
    assert out[26].adx is None and out[27].adx is not None and out[18].ema_fast is None


def test_states_do_not_depend_on_later_bars_or_row_order(spark):
    r = random.Random(3)
    closes = [100 + 5 * math.sin(k / 9) + r.uniform(-1, 1) for k in range(320)]
    whole = with_states(series(spark, closes).repartition(7))
    part = with_states(series(spark, closes[:280]))
    cols = ("ts_ms", "trend", "direction", "momentum")
    assert whole.filter(F.col("rn") < 280).select(*cols).exceptAll(part.select(*cols)).count() == 0


def test_asof_is_inclusive_with_defaults(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 10, 2), ("A", 12, 3), ("B", 1, 4)], "symbol string, t long, v int")
    right = spark.createDataFrame([("A", 10, "x"), ("A", 11, "y"), ("A", 99, "z")], "symbol string, t long, state string")
    got = {r.v: r.state for r in asof_join(left, right, "symbol", "t", {"state": "none"}).collect()}
    assert got == {1: "none", 2: "x", 3: "y", 4: "none"}


def test_universe_and_liquidity(spark):
    m = spark.createDataFrame([("a", True, "USDT", True), ("b", None, "USDT", True), ("c", True, "BUSD", True), ("d", True, "USDT", None), ("e", True, None, True)], "symbol string, active boolean, quote string, contract boolean")
    t = spark.createDataFrame([("a", 10.0), ("b", 99.0)], "symbol string, quote_volume double")
    assert [r.symbol for r in src.universe(m).collect()] == ["a"]
    assert src.liquid(m.select("symbol"), t, 10.0).count() == 2 and src.liquid(m.select("symbol"), t, 10.1).count() == 1
    assert src.liquid(m.select("symbol"), t.withColumn("quote_volume", F.lit(None).cast("double")), 0).count() == 0


def test_scan_separates_symbols_without_history(spark):
    b = series(spark, range(100, 200), "good").unionAll(series(spark, range(100, 300), "good", "1h", step=60 * MIN)).unionAll(series(spark, [1, 2, 3], "short")).unionAll(series(spark, [1, 2], "only5", "5m"))
    gated = spark.createDataFrame([(s, 1.0) for s in ("good", "short", "only5", "none")], "symbol string, quote_volume double")
    states = scan.latest_states(b, gated, (FAST, TRADE, TREND))
    ok = scan.scan_states(states).collect()
    assert [(r.symbol, r.trend, r.direction, r.momentum) for r in ok] == [("good", "bullish", "up", "none")]
    assert {r.symbol: r.reason for r in scan.scan_errors(states).collect()} == {"short": "atr_history", "only5": "no_15m_bars", "none": "no_15m_bars"}


def touch(spark, side, bars, entry=100.0, atr=1.0, p=BarrierParams()):
    """One signal whose bars ahead are (high, low) pairs."""
    ahead = [{"ts_ms": k, "high": float(h), "low": float(lo)} for k, (h, lo) in enumerate(bars)]
    df = spark.createDataFrame([("A", side, 0, entry, atr, ahead)], "symbol string, side string, entry_ts long, entry double, atr double, ahead array<struct<ts_ms:long,high:double,low:double>>")
    return signals.trades(signals.first_touch(df, p), p).collect()


def test_first_touch(spark):
    assert touch(spark, "LONG", [(102, 97)])[0].exit_reason == "SL"  # both in one bar
    assert touch(spark, "LONG", [(101, 98.0)])[0].exit_price == 98.0  # equality touches
    assert touch(spark, "LONG", [(101, 99), (101.15, 99)])[0].exit_reason == "TP"
    assert touch(spark, "SHORT", [(102.0, 98)])[0].exit_reason == "SL"
    short = touch(spark, "SHORT", [(101, 98.7)])[0]
    assert (short.exit_reason, short.pnl_gross, short.pnl, short.fees) == ("TP", 1.3, 1.22, 0.08)
    assert touch(spark, "LONG", [(101, 99), (101, 99)]) == [] and touch(spark, "LONG", []) == []
    assert touch(spark, "LONG", [(101, 99)], p=BarrierParams(keep_unresolved=True))[0].exit_reason is None


def test_signal_rules(spark):
    cols = "symbol string, timeframe string, ts_ms long, rn long, trend string, direction string, momentum string, atr double, entry double, entry_ts long, ahead int"
    row = lambda rn, trend, way, mom, atr=1.0, entry_ts=1: ("A", "15m", 0, rn, trend, way, mom, atr, 100.0, entry_ts, 0)
    rows = [
        (row(200, "bullish", "up", "breakout_up"), "LONG"),
        (row(199, "bullish", "up", "breakout_up"), None),
        (row(200, "bullish", "up", "none"), None),
        (row(200, "bearish", "down", "none"), "SHORT"),
        (row(200, "bearish", "down", "breakout_up"), None),
        (row(200, "bullish", "up", "breakout_up", entry_ts=None), None),
        (row(200, "bullish", "up", "breakout_up", atr=None), None),
        (row(200, "bullish", "up", "breakout_up", atr=0.26), None),
        (row(200, "bearish", "down", "none", atr=0.01), "SHORT"),
    ]
    for r, want in rows:
        assert [x.side for x in signals.signals(spark.createDataFrame([r], cols)).collect()] == ([want] if want else [])


def made(spark, pnls, side="LONG"):
    rows = [("A", side, k * 1000, p, p + 0.08, 0.08, k) for k, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, side string, entry_ts long, pnl double, pnl_gross double, fees double, exit_ts long")


def test_metrics(spark):
    of = lambda pnls, **k: {r.grp: r for r in met.metrics(made(spark, pnls, **k), chunk_ms=2000).collect()}
    assert all(v == 0 for g in of([]).values() for v in g[1:])
    wins = of([1.0, 2.0])
    assert (wins["ALL"].profit_factor, wins["ALL"].avg_loss, wins["ALL"].max_drawdown, wins["SHORT"].trades) == (0, 0, 0, 0)
    assert of([-2.0, 1.0])["ALL"].max_drawdown == 0
    assert of([1.0, -2.0, 0.5])["ALL"].max_drawdown == -2
    assert of([1.0, -2.0, 0.5, -1.0, -3.0, 9.0])["ALL"].max_drawdown == -5.5
    mixed = of([1.0, 0.0, -1.0])["ALL"]
    assert (mixed.winrate, mixed.expectancy) == (33.33, -0.3333)


def test_report_rounds_binary_values(spark):
    values = [1.005, 0.125, 0.375, 0.015, 0.445, -0.001, -0.0, 0.0, 2.675, -179.985, 1e15 + 0.125, 123456789.005, 0.995, -0.125]
    values += [round(random.Random(k).uniform(-300, 300), 3 + k % 2) for k in range(382)]
    rows = [dict(zip(met.NAMES, values[k : k + 11], strict=True), grp=g) for k in range(0, len(values), 33) for g, k in zip(met.GROUPS, (k, k + 11, k + 22), strict=True)]
    for at in range(0, len(rows), 3):
        schema = "grp string, " + ", ".join(f"{n} double" for n in met.NAMES)
        got = met.metrics_report(spark.createDataFrame([[r["grp"], *(r[n] for n in met.NAMES)] for r in rows[at : at + 3]], schema)).collect()
        want = {n: tuple("%.2f" % r[n] for r in rows[at : at + 3]) for n in met.NAMES}
        assert {r["metric"]: (r["ALL"], r["LONG"], r["SHORT"]) for r in got} == want


def test_resample_and_repeated_bars(spark):
    ticks = spark.createDataFrame([("A", 1, 1, 5.0, 1.0), ("A", 2, 2, 9.0, None), ("A", 2, 3, 3.0, 2.0), ("A", 300_000_000, 4, 7.0, 1.0), (None, 1, 1, 1.0, 1.0), ("A", 3, 9, None, 1.0)], "symbol string, ts_us long, seq long, price double, qty double")
    b = src.resample(ticks, "5m", 300_000).orderBy("ts_ms").collect()
    assert [tuple(r)[2:] for r in b] == [(0, 5.0, 9.0, 3.0, 3.0, 3.0), (300_000, 7.0, 7.0, 7.0, 7.0, 1.0)]
    s = series(spark, [1, 2])
    assert src.unique_bars(s.unionAll(s)).count() == 2
    assert src.resample(ticks.limit(0), "5m", 300_000).count() == 0

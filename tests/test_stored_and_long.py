"""Stored bars and results, options of the evaluation, and indicators against a plain loop over a long series."""

import math
import random

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.config import TIMEFRAMES, BarrierParams
from tidemark.functions.indicators import with_indicators
from tidemark.operators import metrics, scan, signals
from tidemark.operators.states import with_states
from tidemark.plans import registry
from tidemark.sources import bars as src


def walk(n, seed=1):
    r, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        o = price
        price = max(1.0, price + r.gauss(0, 1))
        out.append(("x", "15m", k * 900_000, o, max(o, price) + r.random(), min(o, price) - r.random(), price, 1.0 + r.random()))
    return out


def test_indicators_of_a_long_series_equal_a_loop(spark):
    rows = walk(12_000)
    got = with_indicators(spark.createDataFrame(rows, src.BAR)).orderBy("ts_ms").collect()

    def smooth(values, seed_row, seed, a):
        out, y = [], None
        for k, v in enumerate(values):
            y = None if k < seed_row else seed if k == seed_row else (1 - a) * y + a * v
            out.append(y)
        return out

    close, high, low = ([r[c] for r in rows] for c in (6, 4, 5))
    tr = [high[0] - low[0]] + [max(high[k] - low[k], abs(high[k] - close[k - 1]), abs(low[k] - close[k - 1])) for k in range(1, len(rows))]
    moves = [(0.0, 0.0)] + [(high[k] - high[k - 1], low[k - 1] - low[k]) for k in range(1, len(rows))]
    plus, minus = [u if u > d and u > 0 else 0.0 for u, d in moves], [d if d > u and d > 0 else 0.0 for u, d in moves]
    mean = lambda x, k: sum(x[k - 13 : k + 1]) / 14
    atr = smooth(tr, 13, mean(tr, 13), 1 / 14)
    p, m = smooth(plus, 14, mean(plus, 14), 1 / 14), smooth(minus, 14, mean(minus, 14), 1 / 14)
    dx = [None if a is None else 100 * abs(a - b) / (a + b) for a, b in zip(p, m, strict=True)]
    adx = smooth(dx, 27, mean(dx, 27), 1 / 14)
    for span, name in ((20, "ema_fast"), (50, "ema_slow")):
        want = smooth(close, 0, close[0], 2 / (span + 1))
        assert all(math.isclose(r[name], w, rel_tol=1e-9) for r, w in zip(got[span:], want[span:], strict=True))
    for name, want, first in (("atr", atr, 13), ("adx", adx, 27)):
        assert all(r[name] is None for r in got[:first])
        assert all(math.isclose(r[name], w, rel_tol=1e-8) for r, w in zip(got[first:], want[first:], strict=True))


def test_stored_bars_are_read_once_each(spark, tmp_path):
    bars = registry._all_bars(spark, f"{DATA}/sf0.001")
    path = str(tmp_path / "bars")
    src.write_bars(bars.unionAll(bars.filter("timeframe = '1h'")), path)
    key = lambda df: sorted(map(tuple, df.select("symbol", "timeframe", "ts_ms", "open", "high", "low", "close", "volume").collect()))
    assert key(src.read_bars(spark, path)) == key(bars)
    last = bars.agg(F.max("ts_ms")).first()[0] - 86_400_000
    some = src.read_bars(spark, path, "15m", last)
    assert key(some) == key(bars.filter((F.col("timeframe") == "15m") & (F.col("ts_ms") <= last)))
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(timeframe" in plan and "LessThanOrEqual(ts_ms" in plan


def test_results_are_stored(spark, tmp_path):
    found = registry._supplier_scan(spark, f"{DATA}/sf0.001")
    for _ in range(2):  # a later scan replaces an earlier one
        scan.write_scan(found, str(tmp_path / "scan"))
    assert spark.read.parquet(str(tmp_path / "scan")).count() == found.count() > 0
    made = signals.evaluate(with_states(spark.createDataFrame(walk(3000), src.BAR).unionAll(spark.createDataFrame([(s, "1h", *r) for s, _, *r in walk(3000)][::4], src.BAR)).unionAll(spark.createDataFrame([(s, "5m", *r) for s, _, *r in walk(3000)], src.BAR))))
    signals.write_trades(made, str(tmp_path / "trades"))
    stored = spark.read.parquet(str(tmp_path / "trades"))
    assert stored.count() == made.count() > 0
    curve = metrics.equity_curve(stored).filter("grp = 'ALL'").agg(F.count("*"), F.min("drawdown")).first()
    whole = metrics.metrics(stored).filter("grp = 'ALL'").first()
    assert (whole.trades, whole.max_drawdown) == (curve[0], round(curve[1], 2))


def test_history_limits(spark):
    bars = registry._all_bars(spark, f"{DATA}/sf0.01")
    held = {(r.symbol, r.timeframe): r.n for r in bars.groupBy("symbol", "timeframe").agg(F.count("*").alias("n")).collect()}
    kept = {(r.symbol, r.timeframe): r.n for r in src.history(bars, TIMEFRAMES, 2).groupBy("symbol", "timeframe").agg(F.count("*").alias("n")).collect()}
    assert kept == {k: min(n, {"5m": 776, "15m": 392, "1h": 248}[k[1]]) for k, n in held.items()}


def test_visibility_and_entry_bar(spark):
    bar = lambda tf, t, o, h, l, c: ("x", tf, t, float(o), float(h), float(l), float(c), 1.0)
    states = spark.createDataFrame([("x", "15m", 3_600_000, "a", "b"), ("x", "1h", 3_600_000, "bullish", "none"), ("x", "5m", 3_600_000, "n", "breakout_up")], "symbol string, timeframe string, ts_ms long, trend string, momentum string")
    seen = {v: signals.aligned_states(states, visibility=v).first() for v in ("open", "close")}
    assert (seen["open"].trend, seen["open"].momentum) == ("bullish", "breakout_up")
    assert (seen["close"].trend, seen["close"].momentum) == ("neutral", "none")
    rows = spark.createDataFrame([bar("15m", k, 10, 11, 9, 10) for k in range(5)], src.BAR)
    for entry_bar, want in ((False, [2, 3]), (True, [1, 2, 3])):
        first = signals.with_next_bars(rows, BarrierParams(include_entry_bar=entry_bar)).orderBy("ts_ms").first()
        assert [b.ts_ms for b in first.ahead] == want and first.entry_ts == 1


def test_supplier_scan_makes_bars_of_its_universe_alone(spark):
    plan = registry._supplier_scanned(spark, str(DATA / "sf0.1"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    ticks = [k for k, line in enumerate(plan) if "Relation" in line and "l_orderkey" in line]
    made = [(max(j for j in range(k) if "Aggregate" in plan[j]), k) for k in ticks]
    made = [(j, k) for j, k in made if "_groupingexpression" in plan[j]]  # by symbol and day
    assert made
    for j, k in made:  # between the bars and the table of ticks: the gate, and before it the market list
        assert sum("Join LeftSemi" in line for line in plan[j:k]) == 2

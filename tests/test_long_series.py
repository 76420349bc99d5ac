"""Series in parts, as-of joins in slices, far barriers through an index: against whole series and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_stored_and_long import walk
from tidemark.config import TRADE, BarrierParams
from tidemark.functions.indicators import overlap
from tidemark.functions.series import numbered_by_chunks, owned, split
from tidemark.operators import metrics, signals
from tidemark.operators.asof import asof_join, asof_join_all
from tidemark.operators.states import long_states, with_states
from tidemark.operators.touch import WIDTH, block_index, first_touches, levels_for, runs_between
from tidemark.sources import bars as src


def gappy(n, seed=4):
    """A walk with weeks missing, so that chunks of time hold unequal numbers of bars."""
    r, at, out = random.Random(seed), 0, []
    for s, tf, _, *rest in walk(n, seed):
        at += 900_000 * (1 if r.random() < 0.999 else r.randint(2, 2000))
        out.append((s, tf, at, *rest))
    return out


@pytest.fixture(scope="module")
def hot(spark):
    rows = gappy(9000)
    other = [("y", tf, t, *rest) for _, tf, t, *rest in walk(70, 9)]
    return spark.createDataFrame(rows + other, src.BAR).repartition(5).cache()


def test_numbers_come_from_chunk_counts(spark, hot):
    got = {(r.symbol, r.ts_ms): r.rn for r in numbered_by_chunks(hot, chunk_bars=100).collect()}
    for s in ("x", "y"):
        times = sorted(t for x, t in got if x == s)
        assert [got[s, t] for t in times] == list(range(len(times)))


@pytest.mark.parametrize(("rows", "before", "after"), [(10, 3, 2), (4, 11, 0), (1000, 5, 7)])
def test_parts_hold_what_lies_around_them(spark, rows, before, after):
    bars = spark.createDataFrame(walk(57), src.BAR)
    parts = split(bars, rows, before, after).select("_part", "rn", "_row", "_own").collect()
    for part in {r._part for r in parts}:
        mine = sorted((r for r in parts if r._part == part), key=lambda r: r.rn)
        low, high = max(0, part * rows - before), min(57, (part + 1) * rows + after)
        assert [r.rn for r in mine] == list(range(low, high))
        assert [r._row for r in mine] == list(range(high - low))
        assert [r.rn for r in mine if r._own] == [n for n in range(low, high) if n // rows == part]
    assert owned(split(bars, rows, before, after)).count() == 57


def test_states_of_parts_equal_those_of_whole_series(spark, hot):
    whole = with_states(hot, trade=TRADE)
    parts = long_states(hot, trade=TRADE, rows=1500)
    assert sorted(whole.columns) == sorted(parts.columns)
    got = {(r.symbol, r.ts_ms): r for r in parts.collect()}
    want = whole.collect()
    assert len(got) == len(want) == 9070
    for w in want:
        g = got[w.symbol, w.ts_ms]
        for c in ("rn", "trend", "direction", "momentum", "atr_ok", "vol_ok"):
            assert g[c] == w[c]
        for c in ("ema_fast", "ema_slow", "atr", "adx", "tr", "plus_dm", "minus_dm"):
            assert g[c] == w[c] or math.isclose(g[c], w[c], rel_tol=1e-9)
    assert overlap() > 900


def test_no_task_sorts_a_hot_series(spark, hot):
    plan = long_states(hot, rows=1500)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_part" in line]
    assert dealt and not any("hashpartitioning(symbol#" in line and "_part" not in line and "_chunk" not in line and "timeframe" not in line for line in plan.splitlines())
    sizes = split(hot, 1500, overlap()).groupBy("symbol", "timeframe", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1500 + overlap() and sizes.filter("symbol = 'x'").count() >= 6


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_asof_of_several_sides_in_slices(spark, width):
    r = random.Random(8)
    left = [(r.choice("ab"), r.randrange(300), k) for k in range(200)]
    sides = [[(k, t, f"{n}{k}{t}") for k in "ab" for t in r.sample(range(0, 300), size)] for n, size in (("p", 6), ("q", 90))]
    df = lambda rows, c: spark.createDataFrame(rows, f"k string, t long, {c}")
    got = asof_join_all(df(left, "v int"), [(df(sides[0], "p string"), {"p": "none"}), (df(sides[1], "q string"), {"q": None})], "k", "t", width)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Window [last(" in line for line in plan.splitlines()) == (1 if width is None else 2)  # the second one is over the ends of slices
    found = {x.v: (x.p, x.q) for x in got.collect()}
    assert len(found) == 200
    for k, t, v in left:
        best = [max(((u, x) for kk, u, x in side if kk == k and u <= t), default=(0, None))[1] for side in sides]
        assert found[v] == (best[0] or "none", best[1])
    one = asof_join(df(left, "v int"), df(sides[1], "q string"), "k", "t", {"q": "?"}, width)
    assert {x.v: x.q for x in one.collect()} == {v: q or "?" for v, (_, q) in found.items()}


def test_runs_between_are_few_and_whole(spark):
    df = spark.createDataFrame([(a, b) for a in range(0, 200, 7) for b in range(a, 700, 23)], "a long, b long")
    for r in df.select("a", "b", runs_between("a", "b", 2).alias("runs")).collect():
        covered = sorted(x for run in r.runs for x in range(run.block * WIDTH**run.level, (run.block + 1) * WIDTH**run.level))
        assert covered == list(range(r.a, r.b)) and len(r.runs) <= 2 * WIDTH * 2 + 700 // WIDTH**2


@pytest.mark.parametrize("lookahead", [1, 7, 50, 2000])
def test_far_touches_equal_a_loop(spark, lookahead):
    r = random.Random(lookahead)
    low, high = [], []
    price = 1000.0
    for _ in range(1500):
        price += r.gauss(0, 1)
        low.append(price - r.random())
        high.append(price + r.random())
    bars = spark.createDataFrame([("x", k, low[k], high[k], 10 * k) for k in range(1500)], "symbol string, rn int, low double, high double, ts_ms long")
    asked = [("x", k, r.choice(["LONG", "SHORT"]), r.uniform(1, 30), r.uniform(1, 30)) for k in range(0, 1500, 11)]
    rows = [(s, k, side, low[k] - a if side == "LONG" else high[k] + a, high[k] + b if side == "LONG" else low[k] - b) for s, k, side, a, b in asked]
    found = spark.createDataFrame(rows, "symbol string, rn int, side string, sl double, tp double")
    got = {x.rn: x.touch.ts_ms for x in first_touches(found, bars, lookahead).collect()}
    want = {}
    for _, k, side, sl, tp in rows:
        for j in range(k + 2, min(1500, k + 2 + lookahead)):
            if (low[j] <= sl or high[j] >= tp) if side == "LONG" else (high[j] >= sl or low[j] <= tp):
                want[k] = 10 * j
                break
    assert got == want and (lookahead < 50 or len(want) > 20)
    assert levels_for(2000) == 3 and block_index(bars, 3).filter("level = 3").count() == 3


def test_near_and_far_evaluations_agree(spark):
    whole = spark.createDataFrame(walk(3000), src.BAR).unionAll(spark.createDataFrame([(s, "1h", *r) for s, _, *r in walk(3000)][::4], src.BAR)).unionAll(spark.createDataFrame([(s, "5m", *r) for s, _, *r in walk(3000)], src.BAR))
    states = with_states(whole).cache()
    p = BarrierParams(lookahead=12)
    near = signals.evaluate(states, p)
    found = signals.signals(signals.with_next_bars(signals.aligned_states(states), p), p)
    far = signals.trades(signals.first_touch_far(found, states.filter("timeframe = '15m'"), p), p)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(near) == key(far) and near.count() > 20
    assert key(signals.evaluate(states, p, rows=400, slice_ms=20_000_000)) == key(near)
    wide = signals.with_next_bars(signals.aligned_states(states), BarrierParams(lookahead=2000))
    assert "ahead" not in wide.columns
    kept = BarrierParams(lookahead=100, keep_unresolved=True)
    assert signals.evaluate(states, kept).count() == found.count()

def test_equity_of_skewed_days_in_equal_ranges(spark, request):
    """Nine trades of ten fall on one day; ranges hold equally many all the same, and the curve equals a loop."""
    r = random.Random(12)
    n = 20_000
    rows = [(f"s{k % 40}", r.choice(["LONG", "SHORT"]), (5 * src.DAY_MS if r.random() < 0.9 else r.randrange(30 * src.DAY_MS)) + r.randrange(100_000), round(r.gauss(0, 1), 3), 1.0, 0.08, k) for k in range(n)]
    made = spark.createDataFrame(rows, "symbol string, side string, entry_ts long, pnl double, pnl_gross double, fees double, exit_ts long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one range
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    local = metrics._local(made, None)
    held = [x["count"] for x in local.groupBy("_chunk").count().collect()]
    assert len(held) >= 4 and max(held) <= 2 * sorted(held)[len(held) // 2]
    curve = {}
    for x in metrics.equity_curve(made).collect():
        curve.setdefault(x.grp, []).append(x)
    for grp, got in curve.items():
        mine = sorted((t[2], t[0], t[6], t[3]) for t in rows if grp in ("ALL", t[1]))
        got.sort(key=lambda x: (x.entry_ts, x.symbol))
        equity, peak, deepest = 0.0, -math.inf, 0.0
        for (ts, symbol, _, pnl), x in zip(mine, got, strict=True):
            equity += pnl
            peak = max(peak, equity)
            deepest = min(deepest, equity - peak)
            assert (x.entry_ts, x.symbol) == (ts, symbol)
        last = max(got, key=lambda x: (x.entry_ts, x.symbol))
        assert math.isclose(sum(x.pnl for x in got), equity, abs_tol=1e-6) and math.isclose(max(x.peak for x in got), peak, abs_tol=1e-6)
        assert math.isclose(min(x.drawdown for x in got), deepest, abs_tol=1e-6) and last is not None
        assert math.isclose({m.grp: m for m in metrics.metrics(made).collect()}[grp].max_drawdown, deepest, abs_tol=0.006)
    assert {m.grp: m.net_pnl for m in metrics.metrics(made).collect()} == {m.grp: m.net_pnl for m in metrics.metrics(made, chunk_ms=src.DAY_MS).collect()}

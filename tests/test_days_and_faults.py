"""Histories in parts of time, stores that are written again, late ticks, bad ticks, and the gates of a scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_stored_and_long import walk
from tidemark.config import FAST, TRADE, TREND, StateParams
from tidemark.operators import resume, scan, signals
from tidemark.operators.states import with_states
from tidemark.plans import registry
from tidemark.sources import bars as src
from tidemark.sources import quality, volume
from tidemark.sources.stored import replace_days, written

TICK = "symbol string, ts_us long, seq long, price double, qty double"


def test_history_in_parts_equals_the_whole(spark):
    rows = walk(900) + [("y", tf, t, *r) for _, tf, t, *r in walk(50, 3)] + [("z", tf, t + 700 * 900_000, *r) for _, tf, t, *r in walk(90, 5)]
    bars = spark.createDataFrame(rows, src.BAR)
    whole = {(r.symbol, r.ts_ms): r for r in with_states(bars, trade=TRADE).collect()}
    held, done = None, {}
    for low, high in ((0, 30), (30, 400), (400, 401), (401, 760), (760, 900)):
        some = bars.filter(F.col("ts_ms").between(low * 900_000, high * 900_000 - 1))
        if held is None:
            states = with_states(some, trade=TRADE)
        else:
            again = bars.filter(F.col("ts_ms").between((low - 5) * 900_000, low * 900_000 - 1))  # told already
            states = resume.resumed_states(held, some.unionAll(again.filter("symbol = 'x'")), trade=TRADE)
        states = written(states, "states")
        done |= {(r.symbol, r.ts_ms): r for r in states.collect()}
        new = states.select(*resume.BAR_COLUMNS, "rn", *resume.SMOOTHED)
        held = written(resume.tail(new if held is None else held.unionByName(new)), "held")
        assert held.groupBy("symbol").count().agg(F.max("count")).first()[0] <= resume.TAIL
    assert done.keys() == whole.keys()
    for key, w in whole.items():
        for c in ("rn", "trend", "direction", "momentum", "atr_ok", "vol_ok"):
            assert done[key][c] == w[c], (key, c)
        for c in ("ema_fast", "ema_slow", "atr", "adx", "ema_slope"):
            assert done[key][c] == w[c] or math.isclose(done[key][c], w[c], rel_tol=1e-9, abs_tol=1e-9), (key, c)
    with pytest.raises(ValueError, match="look back"):
        resume.resumed_states(held, bars, StateParams(slow=100))


def test_volume_at_any_time_equals_a_loop(spark):
    r = random.Random(2)
    ticks = [(r.choice("ab"), r.randrange(4 * src.DAY_MS) * 1000, k, r.uniform(1, 9), r.choice([1.0, 2.0])) for k in range(600)]
    times = [(r.choice("abc"), r.randrange(400) * 900_000) for _ in range(150)]
    df = spark.createDataFrame(ticks + [(None, 5, 1, 1.0, 1.0), ("a", None, 1, 1.0, 1.0), ("a", 7, 1, None, 1.0)], TICK)
    got = {(x.symbol, x.ts_ms): x.quote_volume for x in volume.volume_at(spark.createDataFrame(times, "symbol string, ts_ms long"), volume.volume_buckets(df)).collect()}
    assert got.keys() == set(times)
    for s, t in got:
        want = sum(p * q for k, us, _, p, q in ticks if k == s and t - src.DAY_MS <= us // 1000 < t)
        assert math.isclose(got[s, t], want, abs_tol=1e-6)
    found = spark.createDataFrame([(s, t, 1) for s, t in times], "symbol string, ts_ms long, keep int")
    least = sorted(got.values())[len(got) // 2]
    kept = volume.gated_at(found, df, least).collect()
    assert {(x.symbol, x.ts_ms) for x in kept} == {k for k, v in got.items() if v >= least} and kept[0].keep == 1


def bars_of(df):
    return sorted((r.symbol, r.ts_ms, r.open, r.high, r.low, r.close, round(r.volume, 6)) for r in df.collect())


def test_late_ticks_are_merged_in_any_order(spark, tmp_path):
    r = random.Random(7)
    ticks = [(r.choice("ab"), r.randrange(3 * src.DAY_MS) * 1000, k, r.uniform(1, 9), r.choice([1.0, None])) for k in range(500)]
    loads = [ticks[k::3] for k in range(3)]
    df = lambda rows: spark.createDataFrame(rows, TICK)
    want = bars_of(src.resample(df(ticks), "15m", TRADE.ms))
    for order in ((0, 1, 2), (2, 0, 1)):
        states = [src.bar_states(df(loads[k]), "15m", TRADE.ms) for k in order]
        assert bars_of(src.finished(src.merged(*states))) == want
        path = str(tmp_path / f"bars{order[0]}")
        for k in order:
            src.append_ticks(spark, path, df(loads[k]), "15m", TRADE.ms)
        assert bars_of(src.finished(spark.read.parquet(path))) == want
    folders = sorted(p.name for p in (tmp_path / "bars0" / "timeframe=15m").iterdir())
    assert folders == ["day=1970-01-01", "day=1970-01-02", "day=1970-01-03"]


def test_days_are_replaced_and_files_are_few(spark, tmp_path):
    rows = [(f"s{k % 50}", k * 3_600_000, float(k)) for k in range(96)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, x double").repartition(12)
    path = str(tmp_path / "t")
    for _ in range(2):
        replace_days(df, path, "ts_ms", files=3)
    replace_days(df.filter("ts_ms < 86400000").withColumn("x", F.lit(-1.0)), path, "ts_ms", files=3)
    got = spark.read.parquet(path)
    assert got.count() == 96 and got.filter("x = -1").count() == 24
    assert all(len(list(p.glob("*.parquet"))) <= 3 for p in (tmp_path / "t").iterdir() if p.is_dir())
    made = signals.evaluate(with_states(spark.createDataFrame(walk(3000), src.BAR).unionAll(spark.createDataFrame([(s, "1h", *r) for s, _, *r in walk(3000)][::4], src.BAR)).unionAll(spark.createDataFrame([(s, "5m", *r) for s, _, *r in walk(3000)], src.BAR))))
    for _ in range(2):  # a repeated run leaves the same rows
        signals.write_trades(made, str(tmp_path / "trades"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "trades")).select(made.columns).collect())) == sorted(map(tuple, made.collect()))


def test_bad_ticks_are_told_apart(spark):
    rows = [("a", 1, 1, 5.0, 1.0), ("a", 1, 1, 5.0, 1.0), ("a", 1, 1, 4.0, 1.0), ("a", 1, 2, 5.0, 1.0), (None, 1, 1, 5.0, 1.0), ("b", None, 1, 5.0, 1.0), ("b", 2, 1, None, 1.0), ("c", 2, 1, 0.0, 1.0), ("c", 3, 1, float("nan"), 1.0), ("c", 4, 1, float("inf"), None), ("c", 5, 1, 2.0, None), ("c", 2, 1, 0.0, 1.0)]
    ticks = spark.createDataFrame(rows, TICK)
    judged = quality.judged(ticks)
    counts = {r.reason: (r.ticks, r.symbols) for r in quality.fault_counts(judged).collect()}
    assert counts == {"null_symbol": (1, 0), "null_time": (1, 1), "null_price": (1, 1), "bad_price": (4, 1), "repeated": (2, 1)}
    assert sorted(map(tuple, quality.good(judged).collect())) == [("a", 1, 1, 4.0, 1.0), ("a", 1, 2, 5.0, 1.0), ("c", 5, 1, 2.0, None)]
    assert quality.quarantine(judged).count() == 9
    assert sorted(map(tuple, quality.faulty_symbols(judged).collect())) == [("b", "null_price"), ("b", "null_time"), ("c", "bad_price")]
    assert {r.ticks for r in quality.fault_counts(quality.judged(ticks.limit(0))).collect()} == {0}
    seen, watch = quality.observed(ticks)
    src.resample(seen, "5m", 300_000).collect()
    assert watch.get["rows"] == 12 and watch.get["null_price"] == 1 and watch.get["bad_price"] == 4


def test_errors_of_a_scan_name_bad_ticks(spark):
    states = scan.latest_states(spark.createDataFrame([], src.BAR), spark.createDataFrame([("q", 1.0)], "symbol string, quote_volume double"))
    faulty = spark.createDataFrame([("b", "null_price")], "symbol string, reason string")
    assert sorted(map(tuple, scan.scan_errors(states, faulty=faulty).collect())) == [("b", "null_price"), ("q", "no_15m_bars")]


def test_the_gate_lies_below_the_aggregation(spark):
    """Ticks of symbols that the gate leaves out make no bars: the semi-join is under the partial aggregate."""
    d = f"{DATA}/sf0.01"
    bars, symbols = registry._all_bars(spark, d), registry._gated(spark, d)
    lines = src.restricted(bars, symbols)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = [k for k, line in enumerate(lines) if "Join LeftSemi" in line]
    assert len(joins) == 3  # one for each timeframe's read of the ticks
    for k in joins:
        above = [line for line in lines[:k] if depth(line) < depth(lines[k])]
        assert any("Aggregate" in line for line in above)
        below = [line for line in lines[k + 1 :] if depth(line) > depth(lines[k])]
        assert any("Relation" in line for line in below)
    kept = {r.symbol for r in symbols.collect()}
    made = {r.symbol for r in src.restricted(bars, symbols).select("symbol").distinct().collect()}
    assert made == kept and bars.join(symbols, "symbol", "left_anti").count() > 0
    assert src.restricted(bars, symbols).join(symbols, "symbol", "left_anti").count() == 0


def test_stored_bars_of_some_days_and_symbols(spark, tmp_path):
    bars = registry._all_bars(spark, f"{DATA}/sf0.001")
    src.write_bars(bars, str(tmp_path / "b"))
    low, high = 1_704_240_000_000, 1_704_412_800_000
    some = src.read_bars(spark, str(tmp_path / "b"), "5m", as_of_ms=high, since_ms=low)
    assert bars_of(some) == bars_of(bars.filter(F.col("timeframe") == FAST.timeframe).filter(F.col("ts_ms").between(low, high)))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert src.read_bars(spark, str(tmp_path / "b")).filter(F.col("timeframe") == TREND.timeframe).count() == bars.filter("timeframe = '1h'").count()
    twice = src.repeated_bars(bars.unionAll(bars.filter("timeframe = '1h'")))
    assert {r.timeframe: r.repeated for r in twice.collect()} == {"5m": 0, "15m": 0, "1h": bars.filter("timeframe = '1h'").count()}


def test_time_limits_reach_the_scan(spark):
    d = f"{DATA}/sf0.001"
    for ticks, low, high in ((src.event_ticks, 1_704_240_000_001, 1_704_412_800_000), (src.lineitem_ticks, 794_620_800_000, 909_792_000_000)):
        some = ticks(spark, d, since_ms=low, until_ms=high)
        plan = some._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual" in pushed and "LessThanOrEqual" in pushed
        whole = ticks(spark, d).filter(F.col("ts_us").between(low * 1000, high * 1000))
        assert some.count() == whole.count() > 0 and some.exceptAll(whole).count() == 0

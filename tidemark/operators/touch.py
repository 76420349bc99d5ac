"""First touch of a barrier within a long look-ahead, found through an index of minima and maxima.

The index holds the lowest low and the highest high of every run of WIDTH^k bars that begins at a
multiple of it. The bars ahead of a signal are a few such runs (at most 2 * WIDTH a level); the
first one whose extremes touch a barrier holds the first touch, and is opened level by level, WIDTH runs
at a time. So a look-ahead of thousands of bars costs a signal some dozens of rows, joined by
equal keys, and a bar's row does not grow. A hot symbol's runs are dealt out by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 8


def block_index(bars: DataFrame, levels: int) -> DataFrame:
    """(symbol, level, block, low, high, ts_ms) of bars numbered by rn, in one pass; ts_ms: of the first bar. Level 0 are the bars themselves."""
    runs = F.explode(F.array(*(F.expr(f"named_struct('level', {level}, 'block', cast(rn AS long) div {WIDTH**level})") for level in range(levels + 1)))).alias("run")
    spread = bars.select("symbol", "low", "high", "ts_ms", runs)
    return spread.groupBy("symbol", "run.level", "run.block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("ts_ms").alias("ts_ms"))


def levels_for(lookahead: int) -> int:
    level = 0
    while WIDTH ** (level + 1) <= lookahead:
        level += 1
    return level


def runs_between(first: str, stop: str, levels: int) -> Column:
    """The runs (level, block) that make up the bars first..stop-1, as few as there can be."""

    def blocks(level: int, low: str, high: str) -> str:
        return f"CASE WHEN {low} < {high} THEN transform(sequence({low}, {high} - 1), x -> named_struct('level', {level}, 'block', x)) ELSE array() END"

    out = []
    for level in range(levels + 1):
        size, bigger = WIDTH**level, WIDTH ** (level + 1)
        low, high = f"(({first} + {size - 1}) div {size})", f"(({stop}) div {size})"
        up, down = f"(({first} + {bigger - 1}) div {bigger})", f"(({stop}) div {bigger})"
        alone = blocks(level, low, high)
        out.append(alone if level == levels else f"CASE WHEN {up} < {down} THEN concat({blocks(level, low, f'{up} * {WIDTH}')}, {blocks(level, f'{down} * {WIDTH}', high)}) ELSE {alone} END")
    return F.expr(f"concat({', '.join(out)})")


def first_touches(found: DataFrame, bars: DataFrame, lookahead: int, first: int = 2) -> DataFrame:
    """(symbol, rn, touch) of signals (symbol, rn, side, sl, tp) that touch a barrier in the bars rn + first .. rn + 1 + lookahead; touch: ts_ms, low, high of the bar."""
    levels = levels_for(lookahead)
    index = block_index(bars, levels)
    mine = ["symbol", "rn", "side", "sl", "tp"]
    hit = F.expr("CASE side WHEN 'LONG' THEN low <= sl OR high >= tp ELSE high >= sl OR low <= tp END")
    runs = runs_between(f"(rn + {first})", f"(rn + {2 + lookahead})", levels)
    for level in range(levels, -1, -1):
        asked = found.select(*mine, F.explode(runs).alias("run")).select(*mine, "run.level", "run.block")
        touched = asked.join(index, ["symbol", "level", "block"]).filter(hit)
        # WIDTH^level is exact in long; runs of one signal do not overlap, so their starts tell their order
        start = F.col("block") * F.element_at(F.array(*(F.lit(WIDTH**k).cast("long") for k in range(levels + 1))), F.col("level") + 1)
        found = touched.groupBy(*mine).agg(F.min_by(F.struct("level", "block", "ts_ms", "low", "high"), start).alias("touch"))
        opened = f"transform(sequence(0L, {WIDTH - 1}L), x -> named_struct('level', {level - 1}, 'block', touch.block * {WIDTH} + x))"
        runs = F.expr(f"CASE WHEN touch.level = {level} THEN {opened} ELSE array(named_struct('level', touch.level, 'block', touch.block)) END")
    return found.select("symbol", "rn", F.struct("touch.ts_ms", "touch.low", "touch.high").alias("touch"))

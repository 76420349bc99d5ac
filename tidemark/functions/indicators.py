"""Indicators of bar series: EMA, true range, ATR, directional movement, ADX, rolling means.

Every value depends on the current and earlier rows of its series only (looking back by
rows, never by time), so it equals what a computation on any longer history would give.
Where a series is too short for an indicator, it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import StateParams
from tidemark.functions.recurrence import blocked, memory, recurrences, seeded_sql
from tidemark.sources.bars import KEY, series

#: Two numbers this close, relative to their size, are equal: sums in different orders may differ so much.
TOLERANCE = 1e-12
#: What an indicator computation can be resumed from, besides the bars themselves.
SMOOTHED = ("ema_fast", "ema_slow", "atr", "adx", "plus_smooth", "minus_smooth")


def rows(n: int):
    """The current row and the n - 1 before it."""
    return series().rowsBetween(1 - n, 0)


def above(a: Column, b: Column) -> Column:
    return (a - b) > TOLERANCE * F.greatest(F.abs(a), F.abs(b))


def above_sql(a: str, b: str) -> str:
    return f"({a} - {b} > {TOLERANCE}D * greatest(abs({a}), abs({b})))"


def numbered(bars: DataFrame) -> DataFrame:
    """Adds rn, the row's place in its series from 0."""
    return bars.withColumn("rn", F.row_number().over(series()) - 1)


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def directional_movement(bars: DataFrame) -> DataFrame:
    """Adds plus_dm and minus_dm (0 in the first row)."""
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    moved = bars.select("*", up.alias("_up"), down.alias("_down"))
    return moved.select(*bars.columns, *(F.expr(e) for e in _MOVES))


_MOVES = (
    "CASE WHEN _up > _down AND _up > 0 THEN _up ELSE 0D END AS plus_dm",
    "CASE WHEN _down > _up AND _down > 0 THEN _down ELSE 0D END AS minus_dm",
)


def overlap(p: StateParams = StateParams()) -> int:
    """Rows before a part of a series after which all indicators of the part are what they are in the whole series.

    The slowest average must have forgotten its start, and ADX, which smooths what is smoothed, twice.
    """
    return max(memory(2 / (p.slow + 1)), 2 * memory(1 / p.period)) + p.slow


def along(by: tuple[str, ...] = KEY, before: int | None = None, row: str = "rn") -> str:
    """Window over the rows of blocked series in order; before: how many rows before the current one it holds."""
    frame = "" if before is None else f" ROWS BETWEEN {before} PRECEDING AND CURRENT ROW"
    return f"(PARTITION BY {', '.join(by)} ORDER BY _blk, {row}{frame})"


def blocked_series(bars: DataFrame, by: tuple[str, ...] = KEY, row: str = "rn") -> DataFrame:
    """Bars with rn, _blk and _place, by which all windows of indicators and states are sorted once."""
    if "_blk" in bars.columns:
        return bars
    numbered_ = bars if "rn" in bars.columns else numbered(bars)
    return numbered_.selectExpr("*", *blocked(row))


def with_indicators(bars: DataFrame, p: StateParams = StateParams(), by: tuple[str, ...] = KEY, row: str = "rn") -> DataFrame:
    """Adds rn, tr, plus_dm, minus_dm and SMOOTHED (EMAs, ATR, ADX, smoothed movements), in two layers of recurrences.

    by: what makes a series; `row` numbers its rows from 0 if it is a part of a longer one, whose rows rn numbers. Bars with
    _held ('last' or 'row') and the columns of SMOOTHED under an underscore are known from before (see `resume`).
    """
    n, a = p.period, 1 / p.period
    known = "_held" in bars.columns
    plain = "_blk" not in bars.columns
    own = [c for c in bars.columns if c != "rn" and not c.startswith("_") or c in by]
    kept = [*own, "rn", "_blk", "_place", *([row] if row != "rn" else []), *(["_held", *(f"_{c}" for c in SMOOTHED)] if known else []), *(["_own"] if "_own" in bars.columns else [])]
    w = along(by, row=row)
    b = blocked_series(bars, by, row).selectExpr(
        *kept,
        f"greatest(high - low, abs(high - lag(close) OVER {w}), abs(low - lag(close) OVER {w})) AS tr",
        f"high - lag(high) OVER {w} AS _up",
        f"lag(low) OVER {w} - low AS _down",
    )
    kept.append("tr")
    b = b.selectExpr(*kept, *_MOVES)
    kept += ["plus_dm", "minus_dm"]
    mean = lambda x: f"avg({x}) OVER {along(by, n - 1, row)}"
    old = lambda c: f"_{c}" if known else None
    ema = lambda c, span: (seeded_sql("close", "close", 0, 2 / (span + 1), old(c)), 2 / (span + 1))
    wilder = lambda c, x, first: (seeded_sql(x, mean(x), first, a, old(c)), a)
    layer = {
        "ema_fast": ema("ema_fast", p.fast),
        "ema_slow": ema("ema_slow", p.slow),
        "atr": wilder("atr", "tr", n - 1),
        "plus_smooth": wilder("plus_smooth", "plus_dm", n),
        "minus_smooth": wilder("minus_smooth", "minus_dm", n),
    }
    b = recurrences(b, layer, by, row)
    told = lambda c: f"coalesce(_{c}, {c})" if known else c
    b = b.selectExpr(*kept, *(f"{told(c)} AS {c}" for c in layer))
    kept += layer
    b = b.selectExpr(*kept, f"CASE WHEN rn >= {n} THEN coalesce(try_divide(100 * abs(plus_smooth - minus_smooth), plus_smooth + minus_smooth), 0D) END AS _dx")
    b = recurrences(b, {"adx": wilder("adx", "_dx", 2 * n - 1)}, by, row)
    ready = {"ema_fast": p.fast - 1, "ema_slow": p.slow - 1, "atr": n - 1, "adx": 2 * n - 1, "plus_smooth": n, "minus_smooth": n}
    out = [*own, "rn", "tr", "plus_dm", "minus_dm", *(f"CASE WHEN rn >= {first} THEN {told(c) if c == 'adx' else c} END AS {c}" for c, first in ready.items())]
    inner = [] if plain else [c for c in kept if c.startswith("_") and c not in own and not c.startswith(tuple(f"_{s}" for s in SMOOTHED))]
    return b.selectExpr(*out, *inner)


def atr_expanding(factor: float, period: int) -> Column:
    """Whether the average true range exceeds the mean of its last `period` values, its own included, by the factor."""
    return F.coalesce(above(F.col("atr"), F.avg("atr").over(rows(period)) * factor), F.lit(False))


def volume_above_average(lookback: int) -> Column:
    return F.coalesce(above(F.col("volume"), F.avg("volume").over(rows(lookback))), F.lit(False))


def atr_expanding_sql(factor: float, period: int, by: tuple[str, ...] = KEY, row: str = "rn") -> str:
    """`atr_expanding` over blocked series."""
    return f"coalesce({above_sql('atr', f'(avg(atr) OVER {along(by, period - 1, row)} * {factor!r}D)')}, false)"


def volume_above_average_sql(lookback: int, by: tuple[str, ...] = KEY, row: str = "rn") -> str:
    return f"coalesce({above_sql('volume', f'(avg(volume) OVER {along(by, lookback - 1, row)})')}, false)"

"""Linear recurrences y[t] = (1 - a) * y[t - 1] + u[t] as window expressions.

A series is cut into blocks of rows. Inside a block the recurrence is a running sum of
u * r^-j times r^j (r = 1 - a); what earlier blocks add is carried from their last rows,
of which only so many matter as double precision can tell. All recurrences of a layer share
one sort and are computed together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def memory(a: float) -> int:
    """After how many rows a recurrence with rate a no longer tells, in double precision, where it began."""
    return math.ceil(53 * math.log(2) / -math.log1p(-a))


def blocked(row: str, block: int = BLOCK) -> tuple[str, str]:
    """Expressions of _blk and _place, the block of a row and its place there, that `recurrences` reads."""
    return f"{row} div {block} AS _blk", f"cast({row} % {block} AS double) AS _place"


def recurrences(df: DataFrame, layer: dict[str, tuple[Column | str, float]], keys: tuple[str, ...], row: str = "rn", block: int = BLOCK) -> DataFrame:
    """Adds for each name the recurrence of its input u (0 before the seed, the seed at it, a * x after) with rate a.

    `row` numbers the rows of each series from 0. An input is a column or SQL. Columns _blk and _place, if df has them
    (see `blocked`), are used and kept, so that windows before and after can share the sort by keys, _blk and row.
    """
    own, by = df.columns, ", ".join(keys)
    places = [] if "_blk" in own else [F.expr(e) for e in blocked(row, block)]
    df = df.select("*", *places, *((F.expr(u) if isinstance(u, str) else u).alias(f"_u_{name}") for name, (u, _) in layer.items()))
    inside = f"(PARTITION BY {by}, _blk ORDER BY {row} ROWS UNBOUNDED PRECEDING)"
    sums = (f"sum(_u_{name} * pow({1 / (1 - a)!r}D, _place)) OVER {inside} * pow({1 - a!r}D, _place) AS _b_{name}" for name, (_, a) in layer.items())
    df = df.selectExpr(*own, *(p for p in ("_blk", "_place") if p not in own), *sums)
    carried = []
    for name, (_, a) in layer.items():
        parts = [f"_b_{name}"]
        for k in range(math.ceil(memory(a) / block)):
            before = f"(PARTITION BY {by} ORDER BY _blk RANGE BETWEEN {k + 1} PRECEDING AND {k + 1} PRECEDING)"
            parts.append(f"coalesce(max(CASE WHEN _place = {block - 1} THEN _b_{name} END) OVER {before}, 0D) * pow({1 - a!r}D, _place + {1 + k * block})")
        carried.append(f"{' + '.join(parts)} AS {name}")
    return df.selectExpr(*own, *carried)


def seeded(x: Column, seed: Column, seed_row: int, a: float, row: str = "rn") -> Column:
    """The input of a recurrence that starts with `seed` in seed_row and follows a * x from there."""
    return F.when(F.col(row) < seed_row, 0.0).when(F.col(row) == seed_row, seed).otherwise(a * x)


def seeded_sql(x: str, seed: str, seed_row: int, a: float, held: str | None = None, row: str = "rn") -> str:
    """`seeded` as SQL. held: a value from an earlier computation, with which the recurrence starts where _held marks the last row that was told; 0 in the rows before."""
    old = f"WHEN _held = 'last' THEN {held} WHEN _held = 'row' THEN 0D " if held else ""
    return f"CASE {old}WHEN {row} < {seed_row} THEN 0D WHEN {row} = {seed_row} THEN {seed} ELSE {a!r}D * {x} END"

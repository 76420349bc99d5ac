"""Series too long for one task: numbered by chunks of time, cut into parts that overlap.

A window over a series sorts it in one task. Here the rows of a series are counted by chunks of
time, which partial aggregation does before any shuffle; the counts of the chunks before give
each row its number. Parts are then runs of consecutive numbers, each with rows of the part
before (and after) it, as many as the windows and recurrences of the part look back (and ahead).
Gaps in time do not matter, for parts go by numbers. A hot series is as many tasks as it has parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import KEY, frame_ms

#: Bars that a chunk of time holds if none is missing.
CHUNK_BARS = 4096


def numbered_by_chunks(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Adds rn, the row's place in its series from 0, without sorting a whole series."""
    chunked = bars.withColumn("_chunk", F.floor(F.col("ts_ms") / (frame_ms("timeframe") * chunk_bars)))
    counts = chunked.groupBy(*KEY, "_chunk").agg(F.count("*").alias("_n"))
    moved = counts.select(*KEY, "_chunk", F.expr(f"sum(_n) OVER (PARTITION BY {', '.join(KEY)} ORDER BY _chunk) - _n AS _before"))
    inside = F.row_number().over(Window.partitionBy(*KEY, "_chunk").orderBy("ts_ms")) - 1
    joined = chunked.withColumn("_inside", inside).join(moved, [*KEY, "_chunk"])
    return joined.select(*bars.columns, (F.col("_before") + F.col("_inside")).alias("rn"))


def split(bars: DataFrame, rows: int, before: int, after: int = 0, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Bars with rn, _part, _row (the row's number inside the part) and _own; rows near a part's edge are in the parts beside it too, not as _own."""
    n = numbered_by_chunks(bars, chunk_bars) if "rn" not in bars.columns else bars
    parts = f"explode(sequence(greatest((rn - {after}) div {rows}, 0), (rn + {before}) div {rows})) AS _part"
    dealt = n.selectExpr("*", parts)
    return dealt.selectExpr("*", f"rn - greatest(_part * {rows} - {before}, 0) AS _row", f"rn div {rows} = _part AS _own")


def owned(parts: DataFrame) -> DataFrame:
    """Each row once: as the part computed it that has all it looks back to."""
    return parts.filter("_own").drop("_own")

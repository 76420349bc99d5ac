"""States of new bars from a small table of what earlier bars left behind, so that a new day reads the day.

The table holds the newest rows of each series with their number and smoothed values: enough for every
look-back by rows (the previous bar, slopes, rolling means), and the values from which the averages go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StateParams, Timeframe
from tidemark.functions.indicators import SMOOTHED
from tidemark.operators.states import with_states
from tidemark.sources.bars import KEY, latest

#: Rows kept of each series: more than any look-back, and than the rows after which all averages have begun.
TAIL = 64
BAR_COLUMNS = ("symbol", "timeframe", "ts_ms", "open", "high", "low", "close", "volume")


def tail(states: DataFrame, rows: int = TAIL) -> DataFrame:
    """What to keep of states: the newest rows of each series."""
    return latest(states.select(*BAR_COLUMNS, "rn", *SMOOTHED), rows)


def resumed_states(held: DataFrame, bars: DataFrame, p: StateParams = StateParams(), trade: Timeframe | None = None) -> DataFrame:
    """`with_states` of bars that are newer than the rows of `held`, which tail() has made of the states before them.

    Bars that are not newer than their series' last held row are left out: they were told already. A series that is not
    in `held` begins. The next table is tail() of the held rows and the new states together.
    """
    if TAIL < max(p.slow + p.slope_rows, 2 * p.period, trade.volume_lookback if trade else 0) + 1:
        raise ValueError("the settings look back further than the held rows")
    last = held.groupBy(*KEY).agg(F.max("ts_ms").alias("_last"))
    new = bars.join(last, list(KEY), "left").filter("_last IS NULL OR ts_ms > _last").select(*BAR_COLUMNS)
    old = held.select(*BAR_COLUMNS, "rn", *(F.col(c).alias(f"_{c}") for c in SMOOTHED), F.lit(False).alias("is_new"))
    both = old.unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    series = f"PARTITION BY {', '.join(KEY)}"
    numbered = both.selectExpr("* EXCEPT (rn)", f"coalesce(min(rn) OVER ({series}), 0) AS _first", f"max(rn) OVER ({series}) AS _end", f"row_number() OVER ({series} ORDER BY ts_ms) - 1 AS _at")
    # a series that is held whole is computed again from its first row
    marked = numbered.selectExpr("* EXCEPT (_first, _end, _at)", "_first + _at AS rn", "CASE WHEN is_new OR _first = 0 THEN NULL WHEN _first + _at = _end THEN 'last' ELSE 'row' END AS _held")
    states = with_states(marked, p, trade).filter("is_new")
    return states.select(*(c for c in states.columns if c != "is_new" and not c.startswith("_")))

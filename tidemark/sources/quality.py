"""Rows that make no bar: which, why and how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REASONS = ("null_symbol", "null_time", "null_price", "bad_price", "repeated")


def _fault() -> Column:
    price = F.col("price")
    return (
        F.when(F.col("symbol").isNull(), "null_symbol")
        .when(F.col("ts_us").isNull(), "null_time")
        .when(price.isNull(), "null_price")
        .when(F.isnan(price) | (price <= 0) | (F.abs(price) == float("inf")), "bad_price")
    )


def judged(ticks: DataFrame) -> DataFrame:
    """Ticks with `fault`, null for good ones. Of ticks with one symbol, time and order key all but one are repeated: the one of the smallest price stays.

    Ticks of one key are told apart by a window over that key, so only real repetitions meet in a task.
    """
    marked = ticks.withColumn("fault", _fault())
    copy = "row_number() OVER (PARTITION BY symbol, ts_us, seq, fault IS NULL ORDER BY price, qty)"
    ranked = marked.selectExpr("*", f"CASE WHEN fault IS NULL THEN {copy} END AS _copy")
    return ranked.withColumn("fault", F.when(F.col("_copy") > 1, "repeated").otherwise(F.col("fault"))).drop("_copy")


def good(judged_ticks: DataFrame) -> DataFrame:
    return judged_ticks.filter("fault IS NULL").drop("fault")


def quarantine(judged_ticks: DataFrame) -> DataFrame:
    """The ticks that make no bar, with their fault, to be written beside the bars."""
    return judged_ticks.filter("fault IS NOT NULL")


def fault_counts(judged_ticks: DataFrame) -> DataFrame:
    """(reason, ticks, symbols) for every reason, 0 where there is none; symbols: how many are concerned."""
    counted = judged_ticks.filter("fault IS NOT NULL").groupBy(F.col("fault").alias("reason")).agg(F.count("*").alias("ticks"), F.count_distinct("symbol").alias("symbols"))
    every = judged_ticks.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return every.join(counted, "reason", "left").na.fill(0, ["ticks", "symbols"])


def faulty_symbols(judged_ticks: DataFrame) -> DataFrame:
    """(symbol, reason) of the symbols with ticks that lack a price or time, as errors of a scan; the symbols' other ticks go on."""
    lacking = judged_ticks.filter("symbol IS NOT NULL AND fault IN ('null_time', 'null_price', 'bad_price')")
    return lacking.select("symbol", F.col("fault").alias("reason")).distinct()


def observed(ticks: DataFrame, name: str = "ticks") -> tuple[DataFrame, Observation]:
    """The ticks themselves, and counters of rows by fault that are filled by whatever action reads them: no pass of their own. Repetitions are not counted here."""
    watch = Observation(name)
    fault = _fault()
    return ticks.observe(watch, F.count("*").alias("rows"), *(F.count_if(fault == r).alias(r) for r in REASONS[:-1])), watch

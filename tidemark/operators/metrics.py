"""Metrics of trades for all of them and for each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stored import in_ranges

GROUPS = ("ALL", "LONG", "SHORT")
NAMES = "trades winrate gross_pnl net_pnl fees fee_impact avg_win avg_loss profit_factor expectancy max_drawdown".split()


def grouped(made: DataFrame) -> DataFrame:
    """Every trade under ALL and under its side."""
    return made.withColumn("grp", F.explode(F.array(F.lit("ALL"), F.col("side"))))


ORDER = ("entry_ts", "symbol", "exit_ts", "pnl")


def _local(made: DataFrame, chunk_ms: int | None) -> DataFrame:
    """Grouped trades with _chunk, and the running sum and its maximum inside each chunk.

    Chunks are ranges of equally many trades in the order of the curve, from a table that is read twice; or, with
    chunk_ms, stretches of time, which need no table but may hold very unequal numbers of trades.
    """
    g = grouped(made)
    if chunk_ms is None:
        g = in_ranges(g, ["grp", *ORDER]).withColumnRenamed("_range", "_chunk")
    else:
        g = g.withColumn("_chunk", F.floor(F.col("entry_ts") / chunk_ms))
    inside = f"(PARTITION BY grp, _chunk ORDER BY {', '.join(ORDER)} ROWS UNBOUNDED PRECEDING)"
    return g.selectExpr("*", f"sum(pnl) OVER {inside} AS _sum").selectExpr("*", f"max(_sum) OVER {inside} AS _top")


def _moved(chunks: DataFrame) -> DataFrame:
    """Adds to chunks (grp, _chunk, _total, _top) what the chunks before add up to, and their peak."""
    earlier = "(PARTITION BY grp ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    moved = chunks.selectExpr("*", f"coalesce(sum(_total) OVER {earlier}, 0D) AS _before")
    return moved.selectExpr("*", f"max(_before + _top) OVER {earlier} AS _peak")


def equity_curve(made: DataFrame, chunk_ms: int | None = None) -> DataFrame:
    """(grp, entry_ts, symbol, side, pnl, equity, peak, drawdown) of grouped trades in the order of entry time and symbol.

    Running sums and maxima are taken inside chunks and moved by what the chunks before add up to, so that no task sorts
    a whole group. Trades are made once. See _local for chunks.
    """
    local = _local(made, chunk_ms)
    whole = _moved(local.groupBy("grp", "_chunk").agg(F.sum("pnl").alias("_total"), F.max("_sum").alias("_top"))).select("grp", "_chunk", "_before", "_peak")
    moved = local.join(whole, ["grp", "_chunk"]).selectExpr("*", "_sum + _before AS equity", "greatest(_top + _before, _peak) AS peak")
    return moved.selectExpr("grp", "entry_ts", "symbol", "side", "pnl", "equity", "peak", "equity - peak AS drawdown", "pnl_gross", "fees")


def metrics(made: DataFrame, chunk_ms: int | None = None) -> DataFrame:
    """One row for each of ALL, LONG and SHORT, all zeros where there is no trade.

    Trades are read once: a chunk (see _local) is summed up with its lowest running sum and its own deepest fall, from
    which the fall below the peak of all chunks before follows.
    """
    pnl, win, loss = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") < 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    chunks = _local(made, chunk_ms).groupBy("grp", "_chunk").agg(
        F.count("*").alias("_n"),
        F.count_if(win).alias("_wins"),
        F.count_if(loss).alias("_losses"),
        F.sum(F.when(win, pnl)).alias("_profit"),
        F.sum(F.when(loss, pnl)).alias("_loss"),
        F.sum("pnl_gross").alias("_gross"),
        F.sum("pnl").alias("_total"),
        F.sum("fees").alias("_fees"),
        F.max("_sum").alias("_top"),
        F.min("_sum").alias("_low"),
        F.min_by(F.struct("_sum", "_top"), F.col("_sum") - F.col("_top")).alias("_deepest"),
    )
    before = F.col("_before")  # rounded results should not depend on the form, so falls are taken between equities as in the curve
    fall = F.least(before + F.col("_deepest._sum") - (before + F.col("_deepest._top")), before + F.col("_low") - F.col("_peak"))  # no peak before the first chunk
    a = _moved(chunks).groupBy("grp").agg(
        F.sum("_n").alias("trades"),
        F.sum("_wins").alias("_wins"),
        zero(F.sum("_profit")).alias("_profit"),
        zero(F.abs(F.sum("_loss"))).alias("_loss"),
        zero(F.try_divide(F.sum("_profit"), F.sum("_wins"))).alias("_avg_win"),
        zero(F.try_divide(F.sum("_loss"), F.sum("_losses"))).alias("_avg_loss"),
        F.sum("_gross").alias("_gross"),
        F.sum("_total").alias("_net"),
        F.sum("_fees").alias("_fees"),
        F.min(fall).alias("_drawdown"),
    )
    rate = F.try_divide(F.col("_wins"), F.col("trades"))
    rows = a.select(
        "grp",
        "trades",
        F.round(rate * 100, 2).alias("winrate"),
        F.round("_gross", 2).alias("gross_pnl"),
        F.round("_net", 2).alias("net_pnl"),
        F.round("_fees", 2).alias("fees"),
        F.round(zero(F.try_divide(F.abs("_fees"), F.abs("_gross")) * 100), 2).alias("fee_impact"),
        F.round("_avg_win", 3).alias("avg_win"),
        F.round("_avg_loss", 3).alias("avg_loss"),
        F.round(zero(F.try_divide(F.col("_profit"), F.col("_loss"))), 2).alias("profit_factor"),
        F.round(rate * F.col("_avg_win") + (1 - rate) * F.col("_avg_loss"), 4).alias("expectancy"),
        F.round("_drawdown", 2).alias("max_drawdown"),
    )
    groups = made.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string")
    return groups.join(rows, "grp", "left").na.fill(0, NAMES)


def _two_decimals(c: str) -> Column:
    """A double as C's printf writes it with "%.2f": its binary value is rounded, a tie to the even digit.

    format_string and round start from the shortest decimal form instead, to which 1.005 (1.00499...) lies in the middle.
    The part after the point times 2^60 is a whole number, but for parts so small that they are 0.00 anyway.
    """
    whole, one = f"floor(abs({c}))", f"{1 << 60}"
    part = f"(cast(cast((abs({c}) - {whole}) * {one}D AS bigint) AS decimal(19, 0)) * 100)"
    cents, rest, half = f"({part} div {one})", f"({part} % {one})", f"{1 << 59}"
    up = f"CASE WHEN {rest} > {half} OR {rest} = {half} AND {cents} % 2 = 1 THEN 1 ELSE 0 END"
    digits = f"cast((cast({whole} AS decimal(20, 0)) * 100 + {cents} + {up}) * 0.01BD AS decimal(24, 2))"
    sign = f"CASE WHEN cast({c} AS string) LIKE '-%' THEN '-' ELSE '' END"
    return F.expr(f"CASE WHEN abs({c}) < {1 << 53} THEN concat({sign}, {digits}) ELSE format_string('%.2f', {c}) END")


def metrics_report(measured: DataFrame) -> DataFrame:
    """Metric names as rows, groups as columns, two decimals."""
    long = measured.select("grp", *(F.col(c).cast("double").alias(c) for c in NAMES)).unpivot("grp", NAMES, "metric", "value")
    wide = long.groupBy("metric").pivot("grp", list(GROUPS)).agg(F.first("value"))
    return wide.select("metric", *(_two_decimals(g).alias(g) for g in GROUPS))


def trade_report(made: DataFrame) -> DataFrame:
    """Trades with readable times; no trades give no rows."""
    time = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "MM-dd HH:mm")
    return made.withColumn("entry_time", time("entry_ts")).withColumn("exit_time", time("exit_ts"))

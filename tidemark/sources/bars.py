"""Bars (candles), market lists and tickers from tables of ticks.

A tick is (symbol, ts_us, seq, price, qty); a bar is (symbol, timeframe, ts_ms, open, high,
low, close, volume), stamped with the start of its interval. Bars are aggregated with
partial sums before the one shuffle, so a symbol with very many ticks costs one row for each
bar and input partition. Ticks with a null symbol, time or price make no bar; a null
quantity counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType

from tidemark.config import Timeframe
from tidemark.sources.stored import replace_days, written

BAR = "symbol string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double"
KEY = ("symbol", "timeframe")
DAY_MS = 86_400_000


def series() -> WindowSpec:
    """The rows of each series in time order."""
    return Window.partitionBy(*KEY).orderBy("ts_ms")


def frame_ms(column: str) -> Column:
    """Milliseconds of a timeframe by its name, such as 5m, 1h or 7d."""
    unit = F.create_map(*(F.lit(x) for x in ("s", 1000, "m", 60_000, "h", 3_600_000, "d", DAY_MS)))
    return F.expr(f"cast(left({column}, length({column}) - 1) AS long)") * unit[F.right(F.col(column), F.lit(1))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def between(df: DataFrame, column: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The rows with a time in since_ms..until_ms, both included (UTC), compared in the column's own type, so that the scan can skip what lies outside."""
    kind = df.schema[column].dataType

    def literal(ms: int, up: bool) -> Column:
        if isinstance(kind, DateType):
            return F.lit(date.fromordinal(date(1970, 1, 1).toordinal() + (-(-ms // DAY_MS) if up else ms // DAY_MS)))
        moment = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
        return F.expr(f"timestamp_ntz'{moment.isoformat(' ')}'") if isinstance(kind, TimestampNTZType) else F.timestamp_millis(F.lit(ms))

    if since_ms is not None:
        df = df.filter(F.col(column) >= literal(since_ms, True))
    return df if until_ms is None else df.filter(F.col(column) <= literal(until_ms, False))


def event_ticks(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Ticks of few, dense symbols: the event types."""
    e = between(table(spark, sf_dir, "events"), "ts", since_ms, until_ms)
    return e.select(
        F.col("event_type").alias("symbol"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.struct("event_id").alias("seq"),
        (100 + F.col("value")).alias("price"),
        (1 + F.col("user_id") % 10).cast("double").alias("qty"),
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Ticks of many symbols: one for each supplier."""
    x = between(table(spark, sf_dir, "lineitem"), "l_shipdate", since_ms, until_ms)
    return x.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("qty"),
    )


BAR_STATE = ("first_at", "open", "high", "low", "last_at", "close", "volume")


def bar_states(ticks: DataFrame, timeframe: str, ms: int) -> DataFrame:
    """Bars that later ticks can be merged into: besides their values, the order keys of their first and last tick."""
    t = ticks.filter("symbol is not null and ts_us is not null and price is not null")
    start = (F.floor(F.col("ts_us") / F.lit(ms * 1000)) * ms).cast("long")
    order = F.struct("ts_us", "seq", "price")
    return (
        t.groupBy("symbol", F.lit(timeframe).alias("timeframe"), start.alias("ts_ms"))
        .agg(F.min(order).alias("first_at"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(order).alias("last_at"), F.sum(F.coalesce("qty", F.lit(0.0))).alias("volume"))
        .select(*KEY, "ts_ms", "first_at", F.col("first_at.price").alias("open"), "high", "low", "last_at", F.col("last_at.price").alias("close"), "volume")
    )


def merged(*states: DataFrame) -> DataFrame:
    """Bar states of several loads as one, in whatever order they came; each tick must be in one load only."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    merged_ = every.groupBy(*KEY, "ts_ms").agg(F.min("first_at").alias("first_at"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last_at").alias("last_at"), F.sum("volume").alias("volume"))
    return merged_.select(*KEY, "ts_ms", "first_at", F.col("first_at.price").alias("open"), "high", "low", "last_at", F.col("last_at.price").alias("close"), "volume")


def finished(states: DataFrame) -> DataFrame:
    return states.select(*KEY, "ts_ms", "open", "high", "low", "close", "volume")


def resample(ticks: DataFrame, timeframe: str, ms: int) -> DataFrame:
    """Bars of one timeframe."""
    t = ticks.filter("symbol is not null and ts_us is not null and price is not null")
    start = (F.floor(F.col("ts_us") / F.lit(ms * 1000)) * ms).cast("long")
    order = F.struct("ts_us", "seq", "price")
    return (
        t.groupBy("symbol", start.alias("ts_ms"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(F.coalesce("qty", F.lit(0.0))).alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), "ts_ms", "open", "high", "low", "close", "volume")
    )


def resample_all(ticks: DataFrame, timeframes: Iterable[Timeframe]) -> DataFrame:
    """Bars of several timeframes, the finest first. Each of the others must be a multiple of the finest and is made of its bars, so ticks are read and shuffled once."""
    first, *others = timeframes
    out = finest = resample(ticks, first.timeframe, first.ms)
    for t in others:
        if t.ms % first.ms:
            raise ValueError(f"{t.timeframe} is no multiple of {first.timeframe}")
        out = out.unionAll(rebase(finest, t.timeframe, t.ms))
    return out


def rebase(bars: DataFrame, timeframe: str, ms: int) -> DataFrame:
    """Coarser bars from finer ones, for which the ticks need not be read again."""
    start = (F.floor(F.col("ts_ms") / ms) * ms).cast("long")
    return (
        bars.groupBy("symbol", start.alias("start"))
        .agg(F.min_by("open", "ts_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ms").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("start").alias("ts_ms"), "open", "high", "low", "close", "volume")
    )


def read_bars(spark: SparkSession, path: str, timeframe: str | None = None, as_of_ms: int | None = None, since_ms: int | None = None) -> DataFrame:
    """Stored bars, each once; a timeframe and the first and last time reach the Parquet scan as filters, and leave out the folders of other days."""
    bars = spark.read.schema(f"{BAR}, day date").parquet(path)
    if timeframe is not None:
        bars = bars.filter(F.col("timeframe") == timeframe)
    day = lambda ms: F.date_from_unix_date(F.lit(ms // DAY_MS))
    if since_ms is not None:
        bars = bars.filter((F.col("day") >= day(since_ms)) & (F.col("ts_ms") >= since_ms))
    if as_of_ms is not None:
        bars = as_of(bars.filter(F.col("day") <= day(as_of_ms)), as_of_ms)
    return unique_bars(bars)


def as_of(bars: DataFrame, ms: int | None) -> DataFrame:
    """The bars that start at a time or before it; all of them if it is None."""
    return bars if ms is None else bars.filter(F.col("ts_ms") <= ms)


def write_bars(bars: DataFrame, path: str, files: int = 8) -> None:
    """Stores bars by timeframe and day; the days among them are replaced, so a load can be repeated."""
    replace_days(bars, path, "ts_ms", ("timeframe",), files)


def append_ticks(spark: SparkSession, path: str, ticks: DataFrame, timeframe: str, ms: int, files: int = 8) -> None:
    """Merges late or new ticks into the bar states stored at path, of which only the days concerned are read and replaced."""
    fresh = written(bar_states(ticks, timeframe, ms), "late")
    days = fresh.select(F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int")).alias("day")).distinct()
    try:
        old = spark.read.parquet(path).filter(F.col("timeframe") == timeframe)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        replace_days(fresh, path, "ts_ms", ("timeframe",), files)
        return
    old = written(old.join(days, "day", "left_semi").select(fresh.columns), "touched")
    replace_days(merged(old, fresh), path, "ts_ms", ("timeframe",), files)


def unique_bars(bars: DataFrame) -> DataFrame:
    """One bar for each (symbol, timeframe, ts_ms): of repeated ones the smallest."""
    values = F.struct("open", "high", "low", "close", "volume")
    return bars.groupBy(*KEY, "ts_ms").agg(F.min(values).alias("b")).select(*KEY, "ts_ms", "b.*")


def repeated_bars(bars: DataFrame) -> DataFrame:
    """(timeframe, bars, repeated): how many bars there are, and how many of them unique_bars() leaves out."""
    once = bars.groupBy(*KEY, "ts_ms").agg(F.count("*").alias("n"))
    return once.groupBy("timeframe").agg(F.sum("n").alias("bars"), (F.sum("n") - F.count("*")).alias("repeated"))


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each series; with a fixed n each task forgets older ones before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ts_ms"))
    return bars.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def latest_of_each(bars: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The newest bars of each series, as many as its timeframe's limit; other timeframes go."""
    out = None
    for timeframe, n in limits.items():
        part = latest(bars.filter(F.col("timeframe") == timeframe), n)
        out = part if out is None else out.unionAll(part)
    return out


def history(bars: DataFrame, timeframes: Iterable[Timeframe], days: int, warmup: int = 200) -> DataFrame:
    """What an evaluation of the last days reads of each series: the bars of so many days, and the warm-up before them."""
    return latest_of_each(bars, {t.timeframe: DAY_MS // t.ms * days + warmup for t in timeframes})


def event_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).filter("symbol is not null").distinct()
    return s.select(
        "symbol",
        (F.col("symbol") != "error").alias("active"),
        F.when(F.col("symbol") == "view", "BUSD").otherwise("USDT").alias("quote"),
        F.when(F.col("symbol") != "signup", True).alias("contract"),
    )


def supplier_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        (F.col("s_acctbal") > 0).alias("active"),
        F.when(F.col("s_nationkey") % 5 == 0, "BUSD").otherwise("USDT").alias("quote"),
        F.when(F.col("s_suppkey") % 7 != 0, True).alias("contract"),
    )


def tickers(ticks: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """Quote volume of each symbol over the last window before the newest tick of all."""
    last = ticks.agg(F.max("ts_us").alias("last")).scalar()
    t = ticks.withColumn("_last", last).filter(F.col("ts_us") > F.col("_last") - window_ms * 1000)
    return t.groupBy("symbol").agg(F.sum(F.col("price") * F.col("qty")).alias("quote_volume"))


def universe(markets: DataFrame, quote: str = "USDT") -> DataFrame:
    """Symbols of active contracts in one quote currency; a missing attribute excludes."""
    keep = F.coalesce("active", F.lit(False)) & F.coalesce(F.col("quote") == quote, F.lit(False)) & F.coalesce("contract", F.lit(False))
    return markets.filter(keep).select("symbol")


def liquid(symbols: DataFrame, tickers_: DataFrame, min_quote_volume: float) -> DataFrame:
    """(symbol, quote_volume) of those that trade enough; equality passes, an unknown volume does not."""
    return symbols.join(tickers_, "symbol").filter(F.col("quote_volume") >= min_quote_volume)


def restricted(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """The bars (or ticks) of some symbols.

    A semi-join: the optimizer moves it below what makes the bars of finer rows, so those of other symbols are neither
    aggregated nor shuffled, and a small set of symbols is broadcast by its size.
    """
    return bars.join(symbols.select("symbol"), "symbol", "left_semi")


def unknown_volume(symbols: DataFrame, tickers_: DataFrame) -> DataFrame:
    """The symbols whose volume nobody knows, for which the gate has no answer."""
    return symbols.join(tickers_.filter("quote_volume is not null"), "symbol", "left_anti").select("symbol")

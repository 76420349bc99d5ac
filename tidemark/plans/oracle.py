"""DuckDB SQL for the candle queries, built from a few common table expressions.

Recurrences are in closed form here: pow(r, n) * running sum of u * pow(r, -n).
"""

from __future__ import annotations

MIN_QUOTE_VOLUME = 36_000
#: a time at which a scan of the suppliers finds some, and one so early that some cannot be judged, with its ticker window
BUSY = 909_792_000_000
EARLY, EARLY_WINDOW = 794_620_800_000, 5 * 86_400_000
#: days of a short evaluation
DAYS = 3
#: rows of a part of a long series, and bars ahead in which a far trade may end
PART_ROWS, FAR = 1024, 672
#: a time at which a history is cut in two, and hours whose ticks a feed delivers twice
CUT = 1_705_363_200_000
AGAIN = (1_704_153_600_000, 1_704_182_400_000)

TICKS = """ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS seq, 100 + value AS price, 1.0 * (1 + user_id % 10) AS qty FROM events)"""


def _supplier_ticks(until: int | None = None) -> str:
    where = "" if until is None else f" WHERE epoch_us(l_shipdate) <= {until * 1000}"
    return f"""ticks AS (SELECT l_suppkey::VARCHAR AS symbol, epoch_us(l_shipdate) AS us, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq, l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS qty FROM lineitem{where})"""


SUPPLIER_TICKS = _supplier_ticks()


def _resampled(timeframe: str, ms: int) -> str:
    return f"""SELECT symbol, '{timeframe}' AS timeframe, (us // {ms * 1000}) * {ms} AS ts_ms, arg_min(price, row(us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(us, seq)) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL"""


FRAMES = {"5m": 300_000, "15m": 900_000, "1h": 3_600_000}
BARS = "bars AS (" + " UNION ALL ".join(_resampled(t, ms) for t, ms in FRAMES.items()) + ")"
DAY = 86_400_000
SUPPLIER_BARS = f"bars AS ({_resampled('1d', DAY)} UNION ALL {_resampled('7d', 7 * DAY)})"
_BY = "(PARTITION BY symbol, timeframe ORDER BY ts_ms)"


def _ema(name: str, span: int) -> str:
    r = f"(1 - 2.0 / {span + 1})"
    return f"pow({r}, rn) * sum(CASE WHEN rn = 0 THEN close ELSE close * 2.0 / {span + 1} END * pow({r}, -rn)) OVER w AS {name}"


def _wilder(name: str, x: str, seed_row: int) -> str:
    r = "(13.0 / 14)"
    return f"pow({r}, rn) * sum(CASE WHEN rn < {seed_row} THEN 0 WHEN rn = {seed_row} THEN mean_{x} ELSE {x} / 14.0 END * pow({r}, -rn)) OVER w AS {name}"


def _states(source: str, prefix: str = "") -> str:
    """CTEs from bars `source` to `{prefix}states`."""
    over, p = f"WINDOW w AS {_BY}", prefix
    above = lambda a, b: f"({a} - {b} > 1e-12 * greatest(abs({a}), abs({b})))"
    return f"""
{p}i0 AS (SELECT *, row_number() OVER w - 1 AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM {source} {over}),
{p}i1 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm FROM {p}i0),
{p}i2 AS (SELECT *, avg(tr) OVER v AS mean_tr, avg(plus_dm) OVER v AS mean_plus_dm, avg(minus_dm) OVER v AS mean_minus_dm FROM {p}i1 WINDOW v AS (PARTITION BY symbol, timeframe ORDER BY ts_ms ROWS 13 PRECEDING)),
{p}i3 AS (SELECT *, {_ema('e20', 20)}, {_ema('e50', 50)}, {_wilder('a14', 'tr', 13)}, {_wilder('sp', 'plus_dm', 14)}, {_wilder('sm', 'minus_dm', 14)} FROM {p}i2 {over}),
{p}i4 AS (SELECT *, CASE WHEN rn >= 14 THEN coalesce(100 * abs(sp - sm) / nullif(sp + sm, 0), 0) END AS dx FROM {p}i3),
{p}i5 AS (SELECT *, avg(dx) OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms ROWS 13 PRECEDING) AS mean_dx FROM {p}i4),
{p}i6 AS (SELECT *, {_wilder('adx0', 'dx', 27)} FROM {p}i5 {over}),
{p}i7 AS (SELECT * EXCLUDE (adx0), CASE WHEN rn >= 19 THEN e20 END AS ema_fast, CASE WHEN rn >= 49 THEN e50 END AS ema_slow, CASE WHEN rn >= 13 THEN a14 END AS atr, CASE WHEN rn >= 27 THEN adx0 END AS adx FROM {p}i6),
{p}i8 AS (SELECT *, lag(ema_slow, 3) OVER w AS before, lag(high) OVER w AS high1, lag(low) OVER w AS low1, avg(atr) OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms ROWS 13 PRECEDING) AS atr_mean, avg(volume) OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms ROWS 19 PRECEDING) AS vol_mean, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM {p}i7 {over}),
{p}states AS (SELECT *, ema_slow - before AS ema_slope,
  CASE WHEN rn + 1 < 53 THEN 'neutral' WHEN {above('ema_fast', 'ema_slow')} AND {above('ema_slow', 'before')} AND adx > 15 THEN 'bullish' WHEN {above('ema_slow', 'ema_fast')} AND {above('before', 'ema_slow')} AND adx > 15 THEN 'bearish' ELSE 'neutral' END AS trend,
  CASE WHEN rn + 1 < 50 THEN 'range' WHEN {above('ema_fast', 'ema_slow')} THEN 'up' WHEN {above('ema_slow', 'ema_fast')} THEN 'down' ELSE 'range' END AS direction,
  CASE WHEN close > high1 THEN 'breakout_up' WHEN close < low1 THEN 'breakout_down' ELSE 'none' END AS momentum,
  coalesce({above('atr', '(atr_mean * 1.03)')}, false) AS atr_ok, coalesce({above('volume', 'vol_mean')}, false) AS vol_ok FROM {p}i8)"""


UNIVERSE = """universe AS (SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN ('error', 'view', 'signup'))"""
GATED = f"""{UNIVERSE}, gated AS (SELECT symbol, sum(price * qty) AS quote_volume FROM ticks JOIN universe USING (symbol) WHERE us > (SELECT max(us) FROM ticks) - {DAY * 1000} GROUP BY symbol HAVING sum(price * qty) >= {MIN_QUOTE_VOLUME})"""
SUPPLIER_UNIVERSE = "SELECT s_suppkey::VARCHAR AS symbol FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 5 <> 0 AND s_suppkey % 7 <> 0"


def _supplier_gated(window: int = 365 * DAY) -> str:
    return f"""gated AS (SELECT symbol, sum(price * qty) AS quote_volume FROM ticks JOIN ({SUPPLIER_UNIVERSE}) USING (symbol) WHERE us > (SELECT max(us) FROM ticks) - {window * 1000} GROUP BY symbol)"""


SUPPLIER_GATED = _supplier_gated()


def _scan(fast: str, trade: str, trend: str, candles: dict[str, int]) -> str:
    limit = "CASE timeframe " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in candles.items()) + " END"
    return f"""cut AS (SELECT bars.* FROM bars JOIN gated USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms DESC) <= {limit}), {_states('cut', 'c')},
found AS (SELECT * FROM cstates WHERE rn = n - 1),
scanned AS (SELECT g.symbol, t.trend, d.direction, m.momentum, d.atr_ok, d.vol_ok, d.atr, d.n, g.quote_volume FROM gated g LEFT JOIN found t ON t.symbol = g.symbol AND t.timeframe = '{trend}' LEFT JOIN found d ON d.symbol = g.symbol AND d.timeframe = '{trade}' LEFT JOIN found m ON m.symbol = g.symbol AND m.timeframe = '{fast}'),
scan_states AS (SELECT symbol, coalesce(trend, 'neutral') AS trend, direction, coalesce(momentum, 'none') AS momentum, atr_ok, vol_ok, round(quote_volume, 4) AS quote_volume FROM scanned WHERE atr IS NOT NULL)"""


SCAN = f"{TICKS}, {BARS}, {GATED}, {_scan('5m', '15m', '1h', {'5m': 100, '15m': 100, '1h': 200})}"
_DAILY_CANDLES = {"1d": 100, "7d": 200}
BUSY_SCAN = f"{_supplier_ticks(BUSY)}, {SUPPLIER_BARS}, {SUPPLIER_GATED}, {_scan('1d', '1d', '7d', _DAILY_CANDLES)}"
EARLY_SCAN = f"{_supplier_ticks(EARLY)}, {SUPPLIER_BARS}, {_supplier_gated(EARLY_WINDOW)}, {_scan('1d', '1d', '7d', _DAILY_CANDLES)}"
TRADEABLE = "FROM scan_states WHERE trend = 'bullish' AND direction = 'up' AND momentum = 'breakout_up' AND atr_ok AND vol_ok"
_REASON = "SELECT symbol, CASE WHEN n IS NULL THEN 'no_15m_bars' ELSE 'atr_history' END AS reason FROM scanned WHERE atr IS NULL"
_HISTORY = f"{TICKS}, {BARS}, {_states('bars')}"
_ALIGNED = f"""{_HISTORY},
aligned AS (SELECT b.* EXCLUDE (trend, momentum), coalesce(t.trend, 'neutral') AS trend, coalesce(m.momentum, 'none') AS momentum
 FROM (SELECT * FROM states WHERE timeframe = '15m') b
 ASOF LEFT JOIN (SELECT symbol, ts_ms, trend FROM states WHERE timeframe = '1h') t ON b.symbol = t.symbol AND b.ts_ms >= t.ts_ms
 ASOF LEFT JOIN (SELECT symbol, ts_ms, momentum FROM states WHERE timeframe = '5m') m ON b.symbol = m.symbol AND b.ts_ms >= m.ts_ms)"""
_AHEAD = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (2, 3) for c in ("ts_ms", "high", "low"))
_SIGNALS = f"""{_ALIGNED},
nexts AS (SELECT *, lead(ts_ms) OVER w AS entry_ts, lead(open) OVER w AS entry, {_AHEAD} FROM aligned WINDOW w AS {_BY}),
sided AS (SELECT *, CASE WHEN trend = 'bullish' AND direction = 'up' AND momentum = 'breakout_up' THEN 'LONG' WHEN trend = 'bearish' AND direction = 'down' AND momentum <> 'breakout_up' THEN 'SHORT' END AS side FROM nexts),
signals AS (SELECT * FROM sided WHERE side IS NOT NULL AND rn >= 200 AND entry_ts IS NOT NULL AND atr IS NOT NULL AND (side = 'SHORT' OR atr * 1.15 / entry * 100 >= 0.30))"""


def _touch(ts: str) -> str:
    """What the bars ahead give: each bar's stop before its target, the first bar first."""
    cases = []
    for k in (2, 3):
        stop = f"CASE WHEN side = 'LONG' THEN low{k} <= sl ELSE high{k} >= sl END"
        target = f"CASE WHEN side = 'LONG' THEN high{k} >= tp ELSE low{k} <= tp END"
        cases += [f"WHEN {stop} THEN {ts.format(k=k, x='SL')}", f"WHEN {target} THEN {ts.format(k=k, x='TP')}"]
    return "CASE " + " ".join(cases) + " END"


_TOUCHED = f"""{_SIGNALS},
barred AS (SELECT *, CASE side WHEN 'LONG' THEN entry - 2.0 * atr ELSE entry + 2.0 * atr END AS sl, CASE side WHEN 'LONG' THEN entry + 1.15 * atr ELSE entry - 1.3 * atr END AS tp FROM signals),
touched AS (SELECT *, {_touch('ts_ms{k}')} AS exit_ts, {_touch("'{x}'")} AS exit_reason FROM barred)"""
_TRADES = f"""{_TOUCHED},
priced AS (SELECT *, CASE exit_reason WHEN 'SL' THEN sl ELSE tp END AS exit_price FROM touched WHERE exit_reason IS NOT NULL),
grossed AS (SELECT *, CASE side WHEN 'LONG' THEN (exit_price - entry) / entry * 100 ELSE (entry - exit_price) / entry * 100 END AS gross FROM priced),
trades AS (SELECT symbol, side, entry_ts, exit_ts, round(entry, 6) AS entry, round(exit_price, 6) AS exit_price, round(gross - 0.08, 3) AS pnl, round(gross, 3) AS pnl_gross, round(0.08::DOUBLE, 3) AS fees, exit_reason, round(abs((entry - sl) / entry * 100), 3) AS sl_pct, round(abs((entry - tp) / entry * 100), 3) AS tp_pct, round(abs(sl), 3) AS sl, round(tp, 3) AS tp FROM grossed)"""

#: the first bar of a long look-ahead that touches a barrier, by comparing with each
_FAR_TRADES = f"""{_SIGNALS},
barred AS (SELECT *, CASE side WHEN 'LONG' THEN entry - 2.0 * atr ELSE entry + 2.0 * atr END AS sl, CASE side WHEN 'LONG' THEN entry + 1.15 * atr ELSE entry - 1.3 * atr END AS tp FROM signals),
exits AS (SELECT s.symbol, s.rn, min(b.rn) AS at FROM barred s JOIN states b ON b.symbol = s.symbol AND b.timeframe = '15m' AND b.rn BETWEEN s.rn + 2 AND s.rn + {1 + FAR} AND CASE side WHEN 'LONG' THEN b.low <= sl OR b.high >= tp ELSE b.high >= sl OR b.low <= tp END GROUP BY s.symbol, s.rn),
touched AS (SELECT s.*, b.ts_ms AS exit_ts, CASE WHEN (CASE side WHEN 'LONG' THEN b.low <= sl ELSE b.high >= sl END) THEN 'SL' ELSE 'TP' END AS exit_reason FROM barred s JOIN exits e ON e.symbol = s.symbol AND e.rn = s.rn JOIN states b ON b.symbol = s.symbol AND b.timeframe = '15m' AND b.rn = e.at)"""
_FAR_TRADES += _TRADES.removeprefix(_TOUCHED)


_FEED = f"""{TICKS},
feed AS (SELECT CASE WHEN seq % 211 <> 0 THEN symbol END AS symbol, CASE WHEN seq % 307 <> 0 THEN us END AS us, seq, CASE WHEN symbol <> 'error' OR seq % 7 <> 0 THEN CASE WHEN seq % 401 = 0 THEN -price ELSE price END END AS price, qty FROM ticks
 UNION ALL SELECT * FROM ticks WHERE us BETWEEN {AGAIN[0] * 1000} AND {AGAIN[1] * 1000 - 1}),
faults AS (SELECT *, CASE WHEN symbol IS NULL THEN 'null_symbol' WHEN us IS NULL THEN 'null_time' WHEN price IS NULL THEN 'null_price' WHEN price <= 0 THEN 'bad_price' END AS fault FROM feed),
judged AS (SELECT * REPLACE (CASE WHEN fault IS NULL AND row_number() OVER (PARTITION BY symbol, us, seq, fault IS NULL ORDER BY price, qty) > 1 THEN 'repeated' ELSE fault END AS fault) FROM faults)"""


_RECENT = " ".join(f"WHEN '{t}' THEN {DAY // ms * DAYS + 200}" for t, ms in FRAMES.items())
RECENT_BARS = f"whole_{BARS}, bars AS (SELECT * FROM whole_bars QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms DESC) <= CASE timeframe {_RECENT} END)"


def _metrics(source: str) -> str:
    return f"""grouped AS (SELECT *, unnest(['ALL', side]) AS grp FROM {source}),
summed AS (SELECT *, sum(pnl) OVER (PARTITION BY grp ORDER BY entry_ts, symbol, exit_ts, pnl ROWS UNBOUNDED PRECEDING) AS equity FROM grouped),
curve AS (SELECT *, max(equity) OVER (PARTITION BY grp ORDER BY entry_ts, symbol, exit_ts, pnl ROWS UNBOUNDED PRECEDING) AS peak FROM summed),
measured AS (SELECT grp, count(*) AS trades, 1.0::DOUBLE * count(*) FILTER (pnl > 0) / count(*) AS rate, sum(pnl_gross) AS gross, sum(pnl) AS net, sum(fees) AS fee, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS loss, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS profit, abs(sum(pnl) FILTER (pnl < 0)) AS lost, min(equity - peak) AS down FROM curve GROUP BY grp),
metrics AS (SELECT g.grp, coalesce(trades, 0) AS trades, coalesce(round(rate * 100, 2), 0) AS winrate, coalesce(round(gross, 2), 0) AS gross_pnl, coalesce(round(net, 2), 0) AS net_pnl, coalesce(round(fee, 2), 0) AS fees, coalesce(round(abs(fee) / nullif(abs(gross), 0) * 100, 2), 0) AS fee_impact, coalesce(round(win, 3), 0) AS avg_win, coalesce(round(loss, 3), 0) AS avg_loss, coalesce(round(profit / nullif(lost, 0), 2), 0) AS profit_factor, coalesce(round(rate * win + (1 - rate) * loss, 4), 0) AS expectancy, coalesce(round(down, 2), 0) AS max_drawdown
 FROM (VALUES ('ALL'), ('LONG'), ('SHORT')) g(grp) LEFT JOIN measured USING (grp))"""


_CONFIG = "config(timeframe, candles, atr_period, atr_expansion, volume_lookback, min_quote_volume) AS (VALUES ('5m', 100, 14, 1.05::DOUBLE, 20, 5000000::BIGINT), ('15m', 100, 14, 1.03, 20, 10000000), ('1h', 200, 14, 1.02, 24, 20000000))"
_NAMES = "trades winrate gross_pnl net_pnl fees fee_impact avg_win avg_loss profit_factor expectancy max_drawdown".split()
_BAR_COLUMNS = "symbol, timeframe, ts_ms, open, high, low, close, volume"


def _trade_rows(columns: str, timeframe: str = "15m") -> str:
    return f"WITH {_HISTORY} SELECT symbol, ts_ms, {columns} FROM states WHERE timeframe = '{timeframe}'"


def queries() -> dict[str, str]:
    out = {f"bars_{t}": f"WITH {TICKS} {_resampled(t, ms)}" for t, ms in FRAMES.items()}
    rounded = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
    report = " UNION ALL ".join("SELECT '{0}' AS metric, {1} FROM metrics".format(m, ", ".join(f"printf('%.2f', max({m}) FILTER (grp = '{g}')::DOUBLE) AS \"{g}\"" for g in ("ALL", "LONG", "SHORT"))) for m in _NAMES)
    out |= {
        "latest_n_bars": f"WITH {TICKS}, {BARS}, {_CONFIG} SELECT {_BAR_COLUMNS} FROM bars JOIN config USING (timeframe) QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts_ms DESC) <= candles",
        "config_join": f"WITH {TICKS}, {BARS}, {_CONFIG}, counted AS (SELECT timeframe, count(*) AS n_bars FROM bars GROUP BY timeframe) SELECT * FROM counted JOIN config USING (timeframe)",
        "universe": f"WITH {UNIVERSE} SELECT * FROM universe",
        "liquid_universe": f"WITH {TICKS}, {GATED} SELECT symbol, round(quote_volume, 4) AS quote_volume FROM gated",
        "ema_20_50": _trade_rows(rounded("ema_fast", "ema_slow")),
        "true_range": _trade_rows(rounded("tr")),
        "atr_14": _trade_rows(rounded("atr")),
        "directional_movement": _trade_rows(rounded("plus_dm", "minus_dm")),
        "adx_14": _trade_rows(rounded("adx")),
        "ema_slope": _trade_rows(rounded("ema_slope")),
        "trend_bias": _trade_rows("trend", "1h"),
        "trade_direction": _trade_rows("direction"),
        "momentum": _trade_rows("momentum", "5m"),
        "latest_momentum": f"WITH {_HISTORY} SELECT symbol, ts_ms, momentum, n AS n_bars FROM states WHERE timeframe = '5m' AND rn = n - 1",
        "atr_expanding": _trade_rows("atr_ok"),
        "volume_above_avg": _trade_rows("vol_ok"),
        "scan_states": f"WITH {SCAN} SELECT * FROM scan_states",
        "scan_tradeable": f"WITH {SCAN} SELECT symbol, trend, direction, momentum, quote_volume {TRADEABLE}",
        "scan_hit_count": f"WITH {SCAN} SELECT count(*) AS hits {TRADEABLE}",
        "scan_errors": f"WITH {SCAN} {_REASON}",
        "supplier_scan_tradeable": f"WITH {BUSY_SCAN} SELECT symbol, trend, direction, momentum, quote_volume {TRADEABLE}",
        "supplier_scan_hit_count": f"WITH {BUSY_SCAN} SELECT count(*) AS hits {TRADEABLE}",
        "supplier_scan_errors": f"WITH {EARLY_SCAN} {_REASON} UNION ALL SELECT symbol, 'no_quote_volume' FROM ({SUPPLIER_UNIVERSE}) WHERE symbol NOT IN (SELECT symbol FROM gated)",
        "recent_trades": f"WITH {_TRADES.replace(BARS, RECENT_BARS)} SELECT * FROM trades",
        "long_series_states": f"WITH {_HISTORY} SELECT symbol, timeframe, ts_ms, rn, {rounded('ema_fast', 'ema_slow', 'atr', 'adx')}, trend, direction, momentum, atr_ok, vol_ok FROM states",
        "resumed_states": f"WITH {_HISTORY} SELECT symbol, timeframe, ts_ms, {rounded('ema_fast', 'ema_slow', 'atr', 'adx')}, trend, direction, momentum, atr_ok, vol_ok FROM states WHERE ts_ms >= {CUT}",
        "gated_signals": f"WITH {_SIGNALS}, traded AS (SELECT s.symbol, s.ts_ms, sum(price * qty) AS quote_volume FROM signals s JOIN ticks t ON t.symbol = s.symbol AND us >= (s.ts_ms - {DAY}) * 1000 AND us < s.ts_ms * 1000 GROUP BY s.symbol, s.ts_ms) SELECT symbol, side, ts_ms, entry_ts, round(quote_volume, 4) AS quote_volume FROM signals JOIN traded USING (symbol, ts_ms) WHERE quote_volume >= {MIN_QUOTE_VOLUME}",
        "stored_bars": f"WITH {TICKS}, {BARS} SELECT {_BAR_COLUMNS} FROM bars WHERE timeframe = '15m' AND ts_ms BETWEEN {AGAIN[0]} AND {CUT}",
        "stored_scan_states": f"WITH {SCAN} SELECT * FROM scan_states",
        "repeated_bars": f"WITH {TICKS}, {BARS} SELECT timeframe, count(*) + count(*) FILTER (ts_ms >= {CUT}) AS bars, count(*) FILTER (ts_ms >= {CUT}) AS repeated FROM bars GROUP BY timeframe",
        "merged_bars": f"WITH {TICKS} {_resampled('15m', FRAMES['15m'])}",
        "feed_faults": f"WITH {_FEED} SELECT reason, count(fault) AS ticks, count(DISTINCT symbol) AS symbols FROM (VALUES ('null_symbol'), ('null_time'), ('null_price'), ('bad_price'), ('repeated')) r(reason) LEFT JOIN judged ON fault = reason GROUP BY reason",
        "feed_errors": f"WITH {_FEED} SELECT DISTINCT symbol, fault AS reason FROM judged WHERE symbol IS NOT NULL AND fault IN ('null_time', 'null_price', 'bad_price')",
        "feed_bars": f"WITH {_FEED.replace('ticks AS (', 'raw AS (', 1).replace('FROM ticks', 'FROM raw')}, ticks AS (SELECT * FROM judged WHERE fault IS NULL) {_resampled('1h', FRAMES['1h'])}",
        "far_trades": f"WITH {_FAR_TRADES} SELECT * FROM trades",
        "state_labels": f"""WITH {SCAN}, labelled AS (SELECT symbol, CASE trend WHEN 'neutral' THEN trend ELSE upper(trend) END AS trend_label, upper(direction) AS direction_label, CASE momentum WHEN 'breakout_up' THEN 'BO UP' WHEN 'breakout_down' THEN 'BO DOWN' ELSE '-' END AS momentum_label, atr_ok, vol_ok FROM scan_states)
SELECT *, concat_ws(' | ', symbol, trend_label, direction_label, momentum_label, atr_ok, vol_ok) AS status FROM labelled""",
        "asof_states": f"WITH {_ALIGNED} SELECT symbol, ts_ms, trend, direction, momentum FROM aligned",
        "signals": f"WITH {_SIGNALS} SELECT symbol, side, ts_ms, entry_ts, {rounded('entry', 'atr')} FROM signals",
        "forward_bars": f"WITH {_SIGNALS} SELECT symbol, ts_ms, 0::BIGINT AS k, ts_ms2 AS bar_ts, high2 AS high, low2 AS low FROM signals WHERE ts_ms2 IS NOT NULL UNION ALL SELECT symbol, ts_ms, 1, ts_ms3, high3, low3 FROM signals WHERE ts_ms3 IS NOT NULL",
        "first_touch": f"WITH {_TOUCHED} SELECT symbol, side, entry_ts, exit_ts, exit_reason, {rounded('sl', 'tp')}, round(CASE exit_reason WHEN 'SL' THEN sl WHEN 'TP' THEN tp END, 6) AS exit_price FROM touched",
        "trades": f"WITH {_TRADES} SELECT * FROM trades",
        "equity_curve": f"WITH {_TRADES}, {_metrics('trades')} SELECT grp, symbol, entry_ts, pnl, round(equity, 6) AS equity, round(peak, 6) AS peak, round(equity - peak, 6) AS drawdown FROM curve",
        "metrics_by_side": f"WITH {_TRADES}, {_metrics('trades')} SELECT * FROM metrics",
        "metrics_empty": f"WITH {_TRADES}, none AS (SELECT * FROM trades WHERE side = 'NEITHER'), {_metrics('none')} SELECT * FROM metrics",
        "metrics_report": f"WITH {_TRADES}, {_metrics('trades')} {report}",
        "trade_report": f"WITH {_TRADES} SELECT *, strftime(make_timestamp(entry_ts * 1000), '%m-%d %H:%M') AS entry_time, strftime(make_timestamp(exit_ts * 1000), '%m-%d %H:%M') AS exit_time FROM trades",
        "supplier_bars": f"WITH {SUPPLIER_TICKS}, {SUPPLIER_BARS} SELECT {_BAR_COLUMNS} FROM bars",
        "supplier_scan_states": f"WITH {SUPPLIER_TICKS}, {SUPPLIER_BARS}, {SUPPLIER_GATED}, {_scan('1d', '1d', '7d', {'1d': 100, '7d': 200})} SELECT * FROM scan_states",
    }
    return out

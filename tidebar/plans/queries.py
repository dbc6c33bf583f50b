"""Registered queries over bars, each with the SQL it is held against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import session as ss
from ..functions import text as tx
from ..operators import combos, desk, frames, repair, resample, scoring
from ..operators import composites as k
from ..operators.kernel import Series
from ..operators.registry import Instance, apply_profile, base_indicators, prepared
from ..sources.scratch import shared_dir
from . import fixtures as fx
from . import oracle as o

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


PX = ["open", "high", "low", "close", "adj_close", "volume"]
BARS = "symbol, ts, open, high, low, close, adj_close, volume"

# ---- bars
query("bars_1h", o.sql(f"SELECT {BARS} FROM h1", "h1"))(lambda s, d: fx.hourly(s, d))
query("bars_4h_anchor17", o.sql(o.fold("h1", o.B4), "h1"))(lambda s, d: resample.resample_4h(fx.hourly(s, d)))
query("bars_130m", o.sql(o.fold("m15", o.B130, f"{o.MOD} BETWEEN 570 AND 960"), "m15"))(lambda s, d: resample.resample_130m(fx.minutes(s, d, 15)))
query("bars_session_daily", o.sql(o.fold("h1", o.TRADE_DATE, "hour(ts) <> 17"), "h1"))(lambda s, d: resample.resample_session_daily(fx.hourly(s, d)))
query("bars_weekly_iso", o.sql(o.fold("d1", "date_trunc('week', ts)", label="t"), "d1"))(lambda s, d: resample.resample_weekly(fx.daily(s, d)))
query("bars_monthly", o.sql(o.fold("d1", "date_trunc('month', ts)", label="t"), "d1"))(lambda s, d: resample.resample_monthly(fx.daily(s, d)))
query("bars_quarterly", o.sql(o.fold("d1", "date_trunc('quarter', ts)::TIMESTAMP"), "d1"))(lambda s, d: resample.resample_quarterly(fx.daily(s, d)))
query("bars_yearly", o.sql(o.fold("d1", "date_trunc('year', ts)::TIMESTAMP"), "d1"))(lambda s, d: resample.resample_yearly(fx.daily(s, d)))
query("resample_rule", o.sql(o.fold("m15", "time_bucket(INTERVAL 30 MINUTES, ts)"), "m15"))(lambda s, d: resample.resample(fx.minutes(s, d, 15), "30 minutes"))
query("tail_bars", o.sql(f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM h1) WHERE r <= 100", "h1"))(lambda s, d: frames.tail_bars(fx.hourly(s, d), 100))
query("snapshot_latest", o.sql(f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM d1) WHERE r = 1", "d1"))(lambda s, d: frames.latest(fx.daily(s, d)))

# ---- session functions
_KEYS = o.sql(
    f"""SELECT event_id, CASE WHEN isodow(ts) = 6 THEN FALSE WHEN isodow(ts) = 7 THEN {o.MOD} >= 1081 WHEN isodow(ts) = 5 THEN {o.MOD} < 961 ELSE TRUE END AS open_session,
  {o.MOD} BETWEEN 570 AND 960 AS regular, {o.TRADE_DATE}::DATE AS trade_date, strftime(ts, '%Y-%m-%d') AS day_key,
  printf('%d-W%02d', isoyear(ts), week(ts)) AS week_key, strftime(ts, '%Y-%m') AS month_key,
  CASE WHEN isodow({o.B4}) = 6 THEN FALSE WHEN isodow({o.B4}) = 7 THEN hour({o.B4}) IN (17, 21) WHEN isodow({o.B4}) = 5 THEN hour({o.B4}) IN (1, 5, 9, 13, 17) ELSE TRUE END AS bucket_ok
FROM events"""
)


@query("session_keys", _KEYS)
def session_keys(s, d):
    e = fx.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("b4", ss.bucket_4h(F.col("ts")))
    t = F.col("ts")
    return e.select(
        "event_id", ss.in_futures_session(t).alias("open_session"), ss.in_regular_session(t).alias("regular"), ss.trade_date(t).alias("trade_date"), ss.run_key(t, "daily").alias("day_key"),
        ss.run_key(t, "weekly").alias("week_key"), ss.run_key(t, "monthly").alias("month_key"), ss.is_extended_4h_bucket(F.col("b4")).alias("bucket_ok"),
    )


# ---- repair and merge
def _dirty(s, d) -> DataFrame:
    t = fx.ticks(s, d).withColumn("price", F.when(F.col("id") % 97 == 0, -F.col("price")).otherwise(F.col("price")))
    return resample.fold_ticks(t, ss.hour_start(F.col("ts")))


_DIRTY = "dirty AS (" + o.fold_ticks("date_trunc('hour', ts)", "(SELECT symbol, ts, id, CASE WHEN id % 97 = 0 THEN -price ELSE price END AS price FROM ticks)") + ")"
_BAD = "(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < low OR (high - low) / nullif(abs(close), 0) > 20)"
_MENDED = f"""{_DIRTY}, flagged AS (SELECT *, {o.yes(_BAD)} AS bad FROM dirty),
 held AS (SELECT *, last_value(CASE WHEN NOT bad THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS good FROM flagged),
 mended AS (SELECT symbol, ts, {', '.join(f'CASE WHEN bad AND good IS NOT NULL THEN good ELSE {c} END AS {c}' for c in PX[:5])}, CASE WHEN bad AND good IS NOT NULL THEN 0.0 ELSE volume END AS volume, bad AND good IS NOT NULL AS repaired, bad FROM held)"""
query("repair_ticks", o.sql(f"SELECT {BARS}, bad, repaired FROM mended", "ticks", extra=_MENDED))(lambda s, d: repair.repair_ticks(_dirty(s, d), 20.0))
query("repair_telemetry", o.sql("SELECT symbol, count(*) AS bars_total, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bars_repaired, 'events' AS source FROM mended GROUP BY symbol HAVING bool_or(bad)", "ticks", extra=_MENDED))(
    lambda s, d: repair.repair_telemetry(repair.repair_ticks(_dirty(s, d), 20.0), "events")
)


def _gappy(s, d) -> DataFrame:
    """Four-hour bars without every fifth day, some without one price, some without any."""
    b = resample.resample_4h(fx.hourly(s, d)).filter(F.dayofmonth("ts") % 5 != 0)
    none = (F.dayofmonth("ts") % 7 == 3) & (F.hour("ts") == 9)
    return b.withColumns({"open": F.when(~none & ~((F.dayofmonth("ts") % 7 == 4) & (F.hour("ts") == 13)), F.col("open")), **{c: F.when(~none, F.col(c)) for c in ("high", "low", "close")}})


_GRID = f"""gappy AS (SELECT symbol, ts, CASE WHEN NOT (day(ts) % 7 = 3 AND hour(ts) = 9 OR day(ts) % 7 = 4 AND hour(ts) = 13) THEN open END AS open,
   {', '.join(f'CASE WHEN NOT (day(ts) % 7 = 3 AND hour(ts) = 9) THEN {c} END AS {c}' for c in PX[1:4])}, adj_close, volume FROM ({o.fold('h1', o.B4)}) WHERE day(ts) % 5 <> 0),
 grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOURS)) AS ts FROM gappy GROUP BY symbol),
 spine AS (SELECT * FROM grid WHERE CASE WHEN isodow(ts) = 6 THEN FALSE WHEN isodow(ts) = 7 THEN hour(ts) IN (17, 21) WHEN isodow(ts) = 5 THEN hour(ts) IN (1, 5, 9, 13, 17) ELSE TRUE END),
 carried AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, coalesce(open, high, low, close) IS NULL AS hole FROM spine LEFT JOIN gappy USING (symbol, ts)),
 filled AS (SELECT symbol, ts, {', '.join(f'CASE WHEN hole THEN c ELSE {x} END AS {x}' for x in PX[:5])}, CASE WHEN hole THEN 0.0 ELSE coalesce(volume, 0.0) END AS volume FROM carried)"""
query("fill_grid_4h", o.sql(f"SELECT {BARS} FROM filled WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL", "h1", extra=_GRID))(lambda s, d: repair.fill_grid(_gappy(s, d)))

_CUT, _OVERLAP = "2024-01-15 00:00:00", "2024-01-14 00:00:00"


def _ts(x: str):
    return F.lit(x).cast("timestamp_ntz")


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    h = fx.hourly(s, d)
    return h.filter(F.col("ts") >= _ts(_OVERLAP)).withColumn("close", F.col("close") + 1), h.filter(F.col("ts") < _ts(_CUT))


_UPSERT = f"""both_ AS (SELECT symbol, ts, open, high, low, close + 1 AS close, adj_close, volume, 1 AS p FROM h1 WHERE ts >= TIMESTAMP '{_OVERLAP}' UNION ALL SELECT {BARS}, 0 AS p FROM h1 WHERE ts < TIMESTAMP '{_CUT}'),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY p DESC) AS r FROM both_) WHERE r = 1),
 last_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS q FROM one)"""
query("upsert_window", o.sql(f"SELECT {BARS} FROM last_n WHERE q <= 500", "h1", extra=_UPSERT))(lambda s, d: repair.upsert_window(*_halves(s, d), 500))
query("hybrid_stitch", o.sql(f"SELECT {BARS} FROM last_n WHERE q <= 450", "h1", extra=_UPSERT.replace(f"WHERE ts < TIMESTAMP '{_CUT}'", f"WHERE ts < TIMESTAMP '{_CUT}' AND symbol NOT IN (SELECT symbol FROM h1 WHERE ts >= TIMESTAMP '{_OVERLAP}' GROUP BY symbol HAVING count(*) >= 450)")))(
    lambda s, d: repair.stitch(*_halves(s, d), 450)
)
_NOW = datetime(2024, 1, 20, 15, 40)


def _partial_sql(bars: str, start: str, hours: int) -> str:
    """Symbols by what they lack: all of it goes by the first letters of their names in order."""
    end = f"TIMESTAMP '{start}' + INTERVAL {hours} HOURS"
    now = f"ts >= TIMESTAMP '{start}' AND ts < {end}"
    extra = f"""names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM h1)),
 old AS (SELECT b.* FROM ({bars}) b JOIN names USING (symbol) WHERE k <> 4 AND (ts < TIMESTAMP '{start}' OR k = 3 AND {now})),
 tk AS (SELECT t.* FROM m15 t JOIN names USING (symbol) WHERE k <> 1 AND (ts < TIMESTAMP '{start}' OR k = 5)),
 made AS ({o.fold('tk', f"TIMESTAMP '{start}'", now)}),
 last_ AS (SELECT symbol, coalesce(b.c, t.c) AS c FROM (SELECT symbol, last(close ORDER BY ts) AS c FROM tk WHERE ts < TIMESTAMP '{start}' AND close IS NOT NULL GROUP BY symbol) t FULL JOIN (SELECT symbol, last(close ORDER BY ts) AS c FROM old WHERE close IS NOT NULL GROUP BY symbol) b USING (symbol) WHERE symbol IN (SELECT symbol FROM tk)),
 stubs AS (SELECT symbol, TIMESTAMP '{start}' AS ts, c AS open, c AS high, c AS low, c AS close, c AS adj_close, 0.0 AS volume FROM last_ WHERE c IS NOT NULL AND symbol NOT IN (SELECT symbol FROM made) AND symbol NOT IN (SELECT symbol FROM old WHERE ts = TIMESTAMP '{start}'))"""
    return o.sql(f"SELECT {BARS} FROM old WHERE NOT (ts = TIMESTAMP '{start}' AND symbol IN (SELECT symbol FROM made)) UNION ALL SELECT {BARS} FROM made UNION ALL SELECT {BARS} FROM stubs", "h1", "m15", extra=extra)


def _patched(s, d, bars: DataFrame, hours: int) -> DataFrame:
    """The first symbol has no ticks, the third a forming bar, the fourth no bars, and only the fifth and those after it ticks of the bucket."""
    h = fx.hourly(s, d)
    names = h.select("symbol").distinct().withColumn("k", F.row_number().over(Window.orderBy("symbol")))  # five symbols
    start = _ts(str(repair.bucket_start(_NOW, hours)))
    now = (F.col("ts") >= start) & (F.col("ts") < start + F.expr(f"INTERVAL {hours} HOURS"))
    old = bars.join(names, "symbol").filter((F.col("k") != 4) & ((F.col("ts") < start) | (F.col("k") == 3) & now)).drop("k")
    ticks = fx.minutes(s, d, 15).join(names, "symbol").filter((F.col("k") != 1) & ((F.col("ts") < start) | (F.col("k") == 5))).drop("k")
    return repair.patch_partial(old, ticks, _NOW, hours)


query("patch_partial_4h", _partial_sql(o.fold("h1", o.B4), "2024-01-20 13:00:00", 4))(lambda s, d: _patched(s, d, resample.resample_4h(fx.hourly(s, d)), 4))
query("patch_partial_1h", _partial_sql("SELECT * FROM h1", "2024-01-20 15:00:00", 1))(lambda s, d: _patched(s, d, fx.hourly(s, d), 1))
query(
    "stub_of_nulls",
    o.sql(f"SELECT {BARS} FROM old UNION ALL SELECT DISTINCT symbol, TIMESTAMP '2024-01-20 15:00:00', {', '.join(['CAST(NULL AS DOUBLE)'] * 6)} FROM old WHERE symbol NOT IN (SELECT symbol FROM old WHERE ts = TIMESTAMP '2024-01-20 15:00:00')", "h1", extra="old AS (SELECT * FROM h1 WHERE ts < TIMESTAMP '2024-01-20 15:00:00' OR symbol > 'e')"),
)(lambda s, d: repair.patch_partial((b := fx.hourly(s, d).filter((F.col("ts") < _ts("2024-01-20 15:00:00")) | (F.col("symbol") > "e"))), b.limit(0), _NOW, stub="null"))
query("gate_closed", o.sql(f"SELECT {BARS} FROM h1 WHERE ts < TIMESTAMP '2024-01-20 15:00:00'", "h1"))(
    # a Saturday: the session is closed, so nothing forms
    lambda s, d: repair.patch_partial((h := fx.hourly(s, d)).filter(F.col("ts") < _ts("2024-01-20 15:00:00")), fx.minutes(s, d, 15), _NOW, gate=ss.in_futures_session(F.col("ts")))
)
query("prefer_source", o.sql(f"SELECT {BARS} FROM h1 WHERE symbol < 'm' UNION ALL SELECT {BARS} FROM m15 WHERE symbol NOT IN (SELECT symbol FROM h1 WHERE symbol < 'm')", "h1", "m15"))(
    lambda s, d: repair.prefer(fx.hourly(s, d).filter("symbol < 'm'"), fx.minutes(s, d, 15))
)


# ---- window primitives, on hourly bars
def windowed(name: str, expr, sql_expr: str, needs: str = "nb", bars: str = "hourly", digits: int = 6):
    def run(s, d):
        return frames.numbered(getattr(fx, bars)(s, d)).withColumn("v", expr()).select("symbol", "ts", F.round("v", digits).alias("v"))

    query(name, o.sql(f"SELECT symbol, ts, round({sql_expr}, {digits}) AS v FROM {needs}", needs))(run)


windowed("sma", lambda: frames.sma("close", 20), o.sma("close", 20))
windowed("sma_adaptive", lambda: frames.sma_adaptive("volume", 26), f"CASE WHEN count(volume) {o.over(26)} >= greatest(4, least(26, count(*) OVER (PARTITION BY symbol)) // 2) AND count(*) OVER (PARTITION BY symbol) >= 4 THEN avg(volume) {o.over(26)} END")
windowed("slope_n", lambda: frames.slope_n("close", 5), f"(close - {o.lag('close', 5)}) / 5")
windowed("ols_slope", lambda: frames.ols_slope("close", 14), o.full("close", 14, f"regr_slope(close, rn) {o.over(14)}"))
windowed("linreg", lambda: frames.linreg("close", 20), o.full("close", 20, f"regr_intercept(close, rn) {o.over(20)} + regr_slope(close, rn) {o.over(20)} * rn"))
windowed("donchian", lambda: frames.donchian(20), f"({o.full('high', 20, f'max(high) {o.over(20)}')} + {o.full('low', 20, f'min(low) {o.over(20)}')}) / 2")
windowed("vwma", lambda: frames.vwma(15), f"{o.rsum('volume * close', 15)} / nullif({o.rsum('volume', 15)}, 0)", digits=9)
windowed("true_range", frames.true_range, "tr")
windowed("daily_sma", lambda: frames.sma("close", 50), o.sma("close", 50), "d1", "daily")


@query("bollinger", o.sql(f"SELECT symbol, ts, round({o.sma('close', 20)} - 2 * {o.full('close', 20, f'stddev_pop(close) {o.over(20)}')}, 6) AS lower, round({o.sma('close', 20)} + 2 * {o.full('close', 20, f'stddev_pop(close) {o.over(20)}')}, 6) AS upper FROM nb", "nb"))
def bollinger(s, d):
    lo, hi = frames.bollinger("close", 20)
    return r6(fx.hourly(s, d).select("symbol", "ts", lo.alias("lower"), hi.alias("upper")), "lower", "upper")


# ---- recursive series, on hourly bars
def _series(s, d, wanted: list[Series], stretch: str | None = None) -> DataFrame:
    return prepared(fx.hourly(s, d).repartition("symbol"), wanted, stretch)


def recursive(name: str, wanted: list[Series], columns: dict, sql_columns: str, src: str = "rs"):
    """The series by one walk over each symbol, and as ``{name}_scan`` put together from stretches of ten bars."""

    def made(stretch):
        return lambda s, d: r6(_series(s, d, wanted, stretch).select("symbol", "ts", *[F.expr(c).alias(n) for n, c in columns.items()]), *columns)

    sql = o.sql(f"SELECT symbol, ts, {sql_columns} FROM {src}", src)
    query(name, sql)(made(None))
    query(f"{name}_scan", sql)(made("10 hours"))


_RANK = o.sql(f"SELECT symbol, ts, round({o.pctrank('volume', 115)}, 6) AS v FROM nb", "nb")
for _name, _stretch in (("pctrank", None), ("pctrank_scan", "3 days")):
    query(_name, _RANK)(lambda s, d, stretch=_stretch: r6(_series(s, d, [Series("v", "pctrank", "volume", 115)], stretch).select("symbol", "ts", "v"), "v"))
windowed("pctrank_window", lambda: frames.pctrank("volume", 20), o.pctrank("volume", 20))
recursive("ema", [Series("ema_21", "ema", "close", 21)], {"v": "ema_21"}, "round(e21, 6) AS v")
recursive("wilder", [Series("w", "wilder", "close", 14)], {"v": "w"}, "round(w14, 6) AS v")
recursive("atr", [Series("a", "wilder", "tr", 14)], {"v": "a"}, "round(a14, 6) AS v")
recursive("macdv", k.needs_macdv(), {"m": "macdv", "s": "macdv_signal"}, "round(m, 6) AS m, round(s, 6) AS s", "mv")
recursive("vma", k.needs_wyckoff(7), {"v": "vma_7"}, "round(vma, 6) AS v")
recursive("keltner", k.needs_squeeze(20), {"lower": "ema_close_20 - 1.5 * atr_20", "upper": "ema_close_20 + 1.5 * atr_20"}, "round(e20 - 1.5 * a20, 6) AS lower, round(e20 + 1.5 * a20, 6) AS upper")


_RSI = o.sql("SELECT symbol, ts, round(CASE WHEN l14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + g14 / l14) END, 6) AS v FROM rs", "rs")
query("rsi", _RSI)(lambda s, d: r6(_series(s, d, k.needs_rsi(14)).select("symbol", "ts", k.rsi(14).alias("v")), "v"))
query("rsi_scan", _RSI)(lambda s, d: r6(_series(s, d, k.needs_rsi(14), "10 hours").select("symbol", "ts", k.rsi(14).alias("v")), "v"))


@query(
    "base_indicator_set",
    o.sql(
        f"""SELECT symbol, ts, round({o.sma('close', 8)}, 6) AS sma_8, round(e8, 6) AS ema_8, round(e21, 6) AS ema_21, round(w14, 6) AS wema_14, round(CASE WHEN l14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + g14 / l14) END, 6) AS rsi_14,
  round((close - {o.lag('close', 5)}) / 5, 6) AS close_slope, round({o.sma('volume', 20)}, 6) AS volume_sma_20, round(a14, 6) AS atr_14 FROM rs""",
        "rs",
    ),
)
def base_indicator_set(s, d):
    names = ["sma_8", "ema_8", "ema_21", "wema_14", "rsi_14", "close_slope", "volume_sma_20", "atr_14"]
    return r6(base_indicators(fx.hourly(s, d).repartition("symbol")).select("symbol", "ts", *names), *names)


# ---- composites, on hourly bars with the parameters of futures 1h
def composite(name: str, instance: Instance, sql: str):
    def run(s, d):
        return apply_profile(fx.hourly(s, d).repartition("symbol"), [instance]).select("symbol", "ts", F.col(instance.key).alias("v"))

    query(name, sql)(run)


def wyckoff_sql(fast: int, inter: int, slow: int) -> str:
    vw = [f"{o.rsum('volume * close', n)} / nullif({o.rsum('volume', n)}, 0)" for n in (fast, inter, slow)]
    return f"""SELECT symbol, ts, CASE WHEN bars < {slow} THEN NULL WHEN {o.yes('close > vma AND f > i AND i > sl')} THEN 2.0 WHEN {o.yes('close < vma AND f < i AND i < sl')} THEN -2.0 WHEN {o.yes('vma > v1')} THEN 1.0 WHEN {o.yes('vma < v1')} THEN -1.0 ELSE 0.0 END AS v
 FROM (SELECT *, {vw[0]} AS f, {vw[1]} AS i, {vw[2]} AS sl, {o.lag('vma')} AS v1 FROM rs)"""


def sigvol_sql(look: int, z: int) -> str:
    sig = f"(SELECT *, ceil({o.pctrank('volume', look)}) AS p FROM nb)"
    return f"SELECT symbol, ts, CASE WHEN {o.yes('p1 >= 67')} OR {o.yes('p2 >= 67')} THEN 2.0 WHEN {o.yes('p1 >= 33')} OR {o.yes('p2 >= 33')} THEN 1.0 ELSE 0.0 END AS v FROM (SELECT *, {o.lag('p', z)} AS p1, {o.lag('p', z + 1)} AS p2 FROM {sig})"


def trend_sql(bull: bool, displace: int, n: int = 10) -> str:
    """Means of one of the lengths that the series have."""
    sm = o.full("c1", n, f"avg(c1) {o.over(n)}") if displace else o.sma("close", n)
    trend = f"(SELECT symbol, ts, {o.lag(f'e{n}', displace)} AS e, {o.lag(f'w{n}', displace)} AS w, {sm} AS sm FROM rs)"
    op, two, one = (">", "2.0", "1.0") if bull else ("<", "-2.0", "-1.0")
    return f"SELECT symbol, ts, CASE WHEN {o.yes(f'e {op} w AND sm {op} w')} THEN {two} WHEN {o.yes(f'e {op} sm')} THEN {one} ELSE 0.0 END AS v FROM {trend}"


composite("ind_wyckoff", Instance("v_", "wyckoff_stage", {"fast": 7, "inter": 15, "slow": 23}), o.sql(wyckoff_sql(7, 15, 23), "rs"))
composite("ind_sigvol", Instance("v_", "significant_volume", {"lookback": 115, "z": 1}), o.sql(sigvol_sql(115, 1), "nb"))
composite("ind_ma_bull", Instance("v_", "movingavg_trend_bullish", {"length": 10, "displace": 1}), o.sql(trend_sql(True, 1), "rs"))
composite("ind_ma_bear", Instance("v_", "movingavg_trend_bearish", {"length": 10, "displace": 1}), o.sql(trend_sql(False, 1), "rs"))


def _macd(z: int) -> str:
    return "(SELECT symbol, ts, " + ", ".join(f"{o.lag(c, z + i)} AS {c}{i}" for c in "ms" for i in (0, 1, 2)) + " FROM mv)"


def _greater(a: str, b: str, bull: bool) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {'greatest' if bull else 'least'}({a}, {b}) END)"


def _strong(i: int, bull: bool) -> str:
    op, t = (">", "45") if bull else ("<", "-45")
    return o.yes(f"{_greater(f'm{i}', f'm{i + 1}', bull)} {op} {t} AND m{i} {op} s{i} AND s{i} {op} s{i + 1}")


def _weak(bull: bool) -> str:
    op, t = (">", "45") if bull else ("<", "-45")
    return " OR ".join([o.yes(f"{_greater('m0', 'm1', bull)} {op} {t}"), o.yes(f"m0 {op} s0 AND s0 {op} s1"), o.yes(f"m0 - s0 {op} m1 - s1 AND m1 - s1 {op} m2 - s2")])


def macdv_sql(bull: bool, z: int) -> str:
    sign = "" if bull else "-"
    return f"SELECT symbol, ts, CASE WHEN {_strong(0, bull)} OR {_strong(1, bull)} THEN {sign}2.0 WHEN {_weak(bull)} THEN {sign}1.0 ELSE 0.0 END AS v FROM {_macd(z)}"


def guard_sql(z: int = 0) -> str:
    return f"SELECT symbol, ts, CASE WHEN {_strong(0, True)} THEN 2.0 WHEN {_strong(0, False)} THEN -2.0 ELSE 0.0 END AS v FROM {_macd(z)}"


def squeeze_sql(z: int) -> str:
    delta = f"close - (({o.full('high', 20, f'max(high) {o.over(20)}')} + {o.full('low', 20, f'min(low) {o.over(20)}')}) / 2 + {o.sma('close', 20)}) / 2"
    band = o.full("close", 20, f"stddev_pop(close) {o.over(20)}")
    sq = f"""(SELECT *, {o.full('delta', 20, f'regr_intercept(delta, rn) {o.over(20)} + regr_slope(delta, rn) {o.over(20)} * rn')} AS dp,
  {' OR '.join(o.yes(f'ub < e20 + {f} * a20 AND lb > e20 - {f} * a20') for f in (1.0, 1.5, 2.0))} AS dot FROM (SELECT *, {delta} AS delta, {o.sma('close', 20)} + 2 * {band} AS ub, {o.sma('close', 20)} - 2 * {band} AS lb FROM rs))"""
    return f"""SELECT symbol, ts, CASE WHEN bars < 20 THEN NULL WHEN (({o.yes('d0 > d1')} OR {o.yes('d1 > d2')}) AND ({o.yes('d0 < d1')} OR {o.yes('d1 < d2')})) OR {o.yes('sq')} THEN 0.0
 WHEN {o.yes('d0 < d1')} OR {o.yes('d1 < d2')} THEN -1.0 WHEN {o.yes('d0 > d1')} OR {o.yes('d1 > d2')} THEN 1.0 END AS v
 FROM (SELECT *, {o.lag('dp', z)} AS d0, {o.lag('dp', z + 1)} AS d1, {o.lag('dp', z + 2)} AS d2, {o.lag('dot', z)} AS sq FROM {sq})"""


composite("ind_macdv_bull", Instance("v_", "macdv_core_bullish", {"z": 1}), o.sql(macdv_sql(True, 1), "mv"))
composite("ind_macdv_bear", Instance("v_", "macdv_core_bearish", {"z": 1}), o.sql(macdv_sql(False, 1), "mv"))
composite("ind_macdv_guard", Instance("v_", "macdv_guard", {"z": 0}), o.sql(guard_sql(), "mv"))
composite("ind_ttm_squeeze", Instance("v_", "ttm_squeeze_pro", {"length": 20, "z": 1}), o.sql(squeeze_sql(1), "rs"))


def exh_ctes(look: int) -> str:
    return f"""x0 AS (SELECT *, greatest(open, close) AS mx, least(open, close) AS mn, CASE WHEN high - low = 0 THEN 0.0 ELSE pow(abs(close - open) * 100, abs(close - open) / (high - low)) END AS cb,
   {o.full('high', 2, f'max(high) {o.over(2)}')} AS hh, {o.full('low', 2, f'min(low) {o.over(2)}')} AS ll FROM nb),
 x1 AS (SELECT *, {o.pctrank('cb', look)} AS cp, {o.pctrank('volume', look)} AS vp, {', '.join(f'{o.lag(c, i)} AS {c}_{i}' for c in ('mx', 'mn') for i in (1, 2, 3))}, {', '.join(f'{o.lag(c, i)} AS {c}_{i}' for c in ('hh', 'll') for i in (1, 2))},
   {', '.join(f'{o.lag(c)} AS {c}_1' for c in ('open', 'close', 'high', 'low'))} FROM x0),
 x2 AS (SELECT *, {o.yes('(33 - floor(vp)) + (33 - floor(cp)) >= 0')} OR {o.yes('(ceil(vp) - 67) + (33 - floor(cp)) >= 0')} AS any_,
   {' OR '.join(o.yes(f'mx >= mx_{i}') for i in (1, 2, 3))} AS nt, {' OR '.join(o.yes(f'mn <= mn_{i}') for i in (1, 2, 3))} AS nb_ FROM x1),
 x3 AS (SELECT *, any_ AND {o.yes('high >= hh_1')} AND nt AND {o.yes('high - mx > 0.5 * (mn - low)')} AS pt, any_ AND {o.yes('low <= ll_1')} AND nb_ AND {o.yes('mn - low > 0.5 * (high - mx)')} AS pb,
   ({o.yes('high >= hh_1')} OR {o.yes('high_1 >= hh_2')}) AND nt AND {o.yes('open >= close_1 AND close < open_1 AND open > close AND open_1 <= close_1 AND (open >= high_1 OR close <= low_1)')} AS et,
   ({o.yes('low <= ll_1')} OR {o.yes('low_1 <= ll_2')}) AND nb_ AND {o.yes('open <= close_1 AND close > open_1 AND open < close AND open_1 >= close_1 AND (open <= low_1 OR close >= high_1)')} AS eb FROM x2)"""


def exh_sql(z: int) -> str:
    if z == 0:
        return "SELECT symbol, ts, CASE WHEN et THEN -2.0 WHEN pt THEN -1.0 WHEN eb THEN 2.0 WHEN pb THEN 1.0 ELSE 0.0 END AS v FROM x3"
    lagged = ", ".join(f"{o.yes(o.lag(c))} AS {c}1" for c in ("pt", "pb", "et", "eb"))
    return f"SELECT symbol, ts, CASE WHEN et1 AND {o.yes('open <= close_1 AND low < low_1')} THEN -2.0 WHEN pt1 AND {o.yes('high <= high_1')} THEN -1.0 WHEN eb1 AND {o.yes('open >= close_1 AND high > high_1')} THEN 2.0 WHEN pb1 AND {o.yes('low >= low_1')} THEN 1.0 ELSE 0.0 END AS v FROM (SELECT *, {lagged} FROM x3)"


composite("ind_exh_abs_z0", Instance("v_", "exh_abs_price_action", {"lookback": 115, "z": 0}), o.sql(exh_sql(0), "nb", extra=exh_ctes(115)))
composite("ind_exh_abs_z1", Instance("v_", "exh_abs_price_action", {"lookback": 115, "z": 1}), o.sql(exh_sql(1), "nb", extra=exh_ctes(115)))


def _benchmarks(s, d) -> DataFrame:
    h = fx.hourly(s, d)
    two = h.select("symbol").distinct().orderBy("symbol").limit(2)
    return h.join(two, "symbol", "left_semi")


@query(
    "ind_volratio",
    o.sql(
        f"""SELECT n.symbol, n.ts, round(n.own / nullif(m.b, 0), 6) AS v FROM (SELECT symbol, ts, CASE WHEN count(volume) {o.over(23)} >= 11 THEN avg(volume) {o.over(23)} END AS own FROM nb) n LEFT JOIN means m ON n.ts = m.ts""",
        "nb",
        extra=f"two AS (SELECT DISTINCT symbol FROM nb ORDER BY symbol LIMIT 2), bm AS (SELECT symbol, ts, CASE WHEN count(volume) {o.over(23)} >= 11 THEN avg(volume) {o.over(23)} END AS m FROM nb WHERE symbol IN (SELECT symbol FROM two)), means AS (SELECT ts, CASE WHEN count(m) = 2 THEN min(m) END AS b FROM bm GROUP BY ts)",
    ),
)
def ind_volratio(s, d):
    out = apply_profile(fx.hourly(s, d).repartition("symbol"), [Instance("v", "spy_qqq_volume_ma_ratio", {"length": 23})], _benchmarks(s, d))
    return r6(out.select("symbol", "ts", "v"), "v")


query("ind_entry_signal", o.sql(f"SELECT symbol, CASE WHEN {o.yes('wyckoff_stage >= 1 AND macdv_guard <= 0')} THEN 1.0 ELSE 0.0 END AS v FROM combo", "combo"))(
    lambda s, d: fx.combo(s, d).select("symbol", k.entry_signal("wyckoff_stage", "macdv_guard", 1.0).alias("v"))
)


# ---- combos and scores
def _ladder(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = fx.hourly(s, d)
    return tuple(frames.latest(x).select("symbol", "ts", "close") for x in (h, resample.resample_4h(h), resample.resample_session_daily(h)))


def _last(src: str) -> str:
    return f"(SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM {src}) WHERE r = 1)"


query(
    "combo_join",
    o.sql(
        f"SELECT l.symbol, l.ts AS lower_date, l.close AS lower_close, m.ts AS middle_date, m.close AS middle_close, u.ts AS upper_date, u.close AS upper_close FROM {_last('h1')} l JOIN {_last('b4')} m USING (symbol) JOIN {_last('sd')} u USING (symbol)",
        "h1",
        extra=f"b4 AS ({o.fold('h1', o.B4)}), sd AS ({o.fold('h1', o.TRADE_DATE, 'hour(ts) <> 17')})",
    ),
)(lambda s, d: combos.build_combo(*_ladder(s, d)))

_SCORES = ("symbol", "signal", "mtf_long_score", "mtf_short_score")


def _side(bull: bool, exh: str) -> str:
    gt, codes, cloud, macd, sq, n = (">", "(1, 2)", "lower_ma_trend_bullish > 0", "lower_macdv_core_bull", ">=", 1) if bull else ("<", "(-1, -2)", "lower_ma_trend_bearish < 0", "lower_macdv_core_bear", "<=", -1)
    regime = f"CASE WHEN upper_wyckoff_stage IS NOT NULL THEN {o.yes(f'upper_wyckoff_stage {gt} 0')} OR {o.yes(f'upper_exh_abs_pa_prior_bar {gt} 0')} ELSE {o.yes(f'middle_wyckoff_stage {gt} 0')} OR {o.yes(f'middle_exh_abs_pa_prior_bar {gt} 0')} END"
    parts = [regime, o.yes(cloud), o.yes(f"{exh} IN {codes}"), f"{o.yes(f'{macd} = {2 * n}')} OR {o.yes(f'{macd} = {n} AND lower_ttm_squeeze_pro {sq} 0')}"]
    return " + ".join(f"(CASE WHEN {p} THEN 1.0 ELSE 0.0 END)" for p in parts)


_BASE = "base AS (SELECT *, {} AS l, {} AS s FROM combo)"
_PRIOR = _BASE.format(_side(True, "lower_exh_abs_pa_prior_bar"), _side(False, "lower_exh_abs_pa_prior_bar"))
_TH = "(CASE WHEN upper_wyckoff_stage IS NOT NULL THEN 0.05 ELSE 0.10 END)"
_LOUD = " OR ".join(o.yes(f"({v} = 2 AND {r} > {_TH}) OR ({v} = 1 AND {r} > 0.25)") for v, r in (("middle_sig_vol_current_bar", "middle_spy_qqq_vol_ma_ratio"), ("lower_sig_vol_prior_bar", "lower_spy_qqq_vol_ma_ratio")))
_SHORTLIST = f"{_PRIOR}, sl AS (SELECT *, CASE WHEN s >= 4 THEN 'short' WHEN l >= 4 THEN 'long' ELSE 'none' END AS sig, CASE WHEN {_LOUD} THEN 1.0 ELSE 0.0 END AS bonus FROM base)"


def score(name: str, evaluator, sql: str):
    query(name, sql)(lambda s, d: scoring.score_combo(fx.combo(s, d), evaluator).select(*_SCORES))


score("score_stocks_shortlist", scoring.stocks_shortlist, o.sql("SELECT symbol, sig AS signal, l + bonus AS mtf_long_score, s + bonus AS mtf_short_score FROM sl", "combo", extra=_SHORTLIST))


def _etf(side: str) -> str:
    c = [f"etf_{tf}_{r}_{side}_score" for tf in ("lower", "middle") for r in ("primary", "secondary")]
    return f"CASE WHEN coalesce({', '.join(c)}) IS NOT NULL THEN greatest({', '.join(f'coalesce({x}, 0)' for x in c)}) END"


_OPTIONS = f"{_SHORTLIST}, cut AS (SELECT *, CASE WHEN sig = 'long' AND l + bonus < 5 THEN 'none' WHEN sig = 'short' AND s + bonus < 5 THEN 'none' ELSE sig END AS c, {_etf('long')} AS el, {_etf('short')} AS es FROM sl)"
score(
    "score_stocks_options",
    scoring.stocks_options,
    o.sql(
        f"SELECT symbol, CASE WHEN c = 'long' AND {o.yes('es >= 4')} THEN 'anti' WHEN c = 'short' AND {o.yes('el >= 4')} THEN 'anti' WHEN c = 'long' AND {o.yes('el < 4')} THEN 'watch' WHEN c = 'short' AND {o.yes('es < 4')} THEN 'watch' ELSE c END AS signal, l + bonus AS mtf_long_score, s + bonus AS mtf_short_score FROM cut",
        "combo",
        extra=_OPTIONS,
    ),
)
_FUTURES = f"{_PRIOR}, fb AS (SELECT *, CASE WHEN l >= 4 THEN 'long' WHEN s >= 4 THEN 'short' ELSE 'none' END AS sig FROM base)"
score("score_futures_base", scoring.futures_base, o.sql("SELECT symbol, sig AS signal, l AS mtf_long_score, s AS mtf_short_score FROM fb", "combo", extra=_FUTURES))


def _volume(some: str, much: str) -> str:
    live = "sig <> 'none' AND upper_wyckoff_stage IS NOT NULL"
    return f"{_FUTURES}, fv AS (SELECT *, CASE WHEN {live} AND ({some}) THEN 1.0 ELSE 0.0 END + CASE WHEN {live} AND ({much}) THEN 1.0 ELSE 0.0 END AS b FROM fb)"


_FV = "SELECT symbol, CASE WHEN sig = 'long' AND l + b < 5 OR sig = 'short' AND s + b < 5 THEN 'none' ELSE sig END AS signal, l + b AS mtf_long_score, s + b AS mtf_short_score FROM fv"
_MID, _LOW = "middle_sig_vol_current_bar", "lower_sig_vol_prior_bar"
score("score_futures_4hdw", scoring.futures_4h_d_w, o.sql(_FV, "combo", extra=_volume(o.yes(f"{_MID} >= 1"), o.yes(f"{_MID} = 2"))))
score("score_futures_dwm", scoring.futures_d_w_m, o.sql(_FV, "combo", extra=_volume(f"{o.yes(f'{_MID} >= 1')} OR {o.yes(f'{_LOW} >= 1')}", f"{o.yes(f'{_MID} = 2')} OR {o.yes(f'{_LOW} = 2')}")))

_TREND_POINTS = ", ".join(f"CASE WHEN {o.yes(f'wyckoff_stage = {2 * n}')} THEN 4.0 ELSE 0.0 END + CASE WHEN {o.yes(f'macdv_guard = {2 * n}')} THEN 2.0 ELSE 0.0 END + CASE WHEN {o.yes('significant_volume = 1')} THEN 1.0 ELSE 0.0 END AS etf_{w}_score" for n, w in ((1, "long"), (-1, "short")))
query("etf_trend", o.sql(f"SELECT symbol AS etf_symbol, {_TREND_POINTS} FROM combo", "combo"))(lambda s, d: scoring.etf_trend(fx.combo(s, d)))
query(
    "etf_trend_first_row",
    o.sql(f"SELECT etf_symbol, etf_long_score, etf_short_score FROM (SELECT CAST(c_nationkey AS VARCHAR) AS etf_symbol, {_TREND_POINTS}, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM combo JOIN customer ON symbol = CAST(c_custkey AS VARCHAR)) WHERE r = 1", "combo"),
)(lambda s, d: scoring.etf_trend(fx.combo(s, d).join(fx.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), "c_nationkey", F.col("c_custkey").alias("pos")), "symbol").withColumn("symbol", F.col("c_nationkey").cast("string"))))


def _funds(s, d) -> DataFrame:
    p = fx.table(s, d, "part")
    return p.groupBy(F.concat_ws(" ", "p_type", "p_name").alias("name")).agg(F.min("p_partkey").alias("pos")).select(F.col("pos").cast("string").alias("symbol"), "name", "pos")


def _stocks(s, d) -> DataFrame:
    return fx.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_brand").alias("name"), F.col("p_type").alias("sector"), F.col("p_name").alias("industry"))


def _etf_map(s, d) -> DataFrame:
    return combos.match_by_tokens(_stocks(s, d), _funds(s, d))


_STOP = "[" + ", ".join("'" + w + "'" for w in tx.STOP_WORDS) + "]"
_STEM = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in tx.STEMS.items()) + "}"
_NOPL = "[" + ", ".join(f"'{w}'" for w in tx.NO_PLURALS) + "]"
_NORM = f"CASE WHEN {_STEM}[t] IS NOT NULL THEN {_STEM}[t] WHEN length(t) <= 3 OR list_contains({_NOPL}, t) THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%s' THEN t[:-2] ELSE t END"


def _tokens(src: str, key: str, c: str) -> str:
    return f"SELECT DISTINCT {key}, n AS token FROM (SELECT {key}, {_NORM} AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({c}), '[a-z0-9]+')) AS t FROM {src}) WHERE NOT list_contains({_STOP}, t)) WHERE NOT list_contains({_STOP}, n) AND n <> ''"


def _best(c: str) -> str:
    return f"""{c}_t AS ({_tokens(f'(SELECT DISTINCT {c} FROM st)', c, c)}), {c}_n AS (SELECT {c}, count(*) AS nt FROM {c}_t GROUP BY {c}),
 {c}_s AS (SELECT a.{c}, f.symbol AS etf, f.name AS etf_name, f.pos, count(*) / (n.nt + m.nf - count(*)) AS sc FROM {c}_t a JOIN {c}_n n USING ({c}) JOIN fu_t b USING (token) JOIN fu_n m ON m.pos = b.pos JOIN fu f ON f.pos = b.pos GROUP BY a.{c}, f.symbol, f.name, f.pos, n.nt, m.nf),
 {c}_b AS (SELECT {c}, etf, etf_name, sc FROM (SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY sc DESC, pos) AS r FROM {c}_s) WHERE r = 1)"""


_MATCH = f"""st AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_brand AS name, p_type AS sector, p_name AS industry FROM part WHERE p_type IS NOT NULL AND p_name IS NOT NULL),
 fu AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS symbol, concat_ws(' ', p_type, p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY concat_ws(' ', p_type, p_name)),
 fu_t AS ({_tokens('fu', 'pos', 'name')}), fu_n AS (SELECT pos, count(*) AS nf FROM fu_t GROUP BY pos), {_best('industry')}, {_best('sector')},
 mt AS (SELECT st.*, i.etf AS industry_etf, i.etf_name AS industry_etf_name, coalesce(i.sc, 0.0) AS industry_score, s.etf AS sector_etf, s.etf_name AS sector_etf_name, coalesce(s.sc, 0.0) AS sector_score FROM st LEFT JOIN industry_b i USING (industry) LEFT JOIN sector_b s USING (sector)),
 mp AS (SELECT *, CASE WHEN industry_score >= 0.2 THEN industry_etf WHEN sector_score >= 0.5 THEN sector_etf ELSE 'SPY' END AS p FROM mt),
 em AS (SELECT symbol, name, sector, industry, industry_etf, industry_etf_name, industry_score, sector_etf, sector_etf_name, sector_score, p AS etf_symbol_primary, CASE WHEN industry_score >= 0.2 AND industry_etf <> p THEN industry_etf WHEN sector_score >= 0.5 AND sector_etf <> p THEN sector_etf END AS etf_symbol_secondary, 'fuzzy' AS etf_match_source FROM mp)"""
query("etf_match", o.sql("SELECT * EXCLUDE (industry_score, sector_score), round(industry_score, 6) AS industry_score, round(sector_score, 6) AS sector_score FROM em", extra=_MATCH))(lambda s, d: r6(_etf_map(s, d).drop("etf_override_notes"), "industry_score", "sector_score"))


def _fund_scores(s, d, shift: int) -> DataFrame:
    f = _funds(s, d)
    return f.select(F.col("symbol").alias("etf_symbol"), ((F.col("pos") + shift) % 7).cast("double").alias("etf_long_score"), ((F.col("pos") + shift) % 5).cast("double").alias("etf_short_score"))


def _fund_sql(shift: int) -> str:
    return f"(SELECT symbol AS e, CAST((pos + {shift}) % 7 AS DOUBLE) AS l, CAST((pos + {shift}) % 5 AS DOUBLE) AS s FROM fu)"


query(
    "etf_attach",
    o.sql(
        f"""SELECT c.symbol, m.etf_symbol_primary, m.etf_symbol_secondary, a.l AS etf_lower_primary_long_score, a.s AS etf_lower_primary_short_score, b.l AS etf_middle_primary_long_score, b.s AS etf_middle_primary_short_score,
  b.l AS etf_primary_long_score, b.s AS etf_primary_short_score, x.l AS etf_lower_secondary_long_score, x.s AS etf_lower_secondary_short_score, y.l AS etf_middle_secondary_long_score, y.s AS etf_middle_secondary_short_score,
  y.l AS etf_secondary_long_score, y.s AS etf_secondary_short_score FROM (SELECT symbol FROM combo) c LEFT JOIN em m USING (symbol) LEFT JOIN {_fund_sql(1)} a ON a.e = m.etf_symbol_primary LEFT JOIN {_fund_sql(2)} b ON b.e = m.etf_symbol_primary
  LEFT JOIN {_fund_sql(1)} x ON x.e = m.etf_symbol_secondary LEFT JOIN {_fund_sql(2)} y ON y.e = m.etf_symbol_secondary""",
        "combo",
        extra=_MATCH,
    ),
)(lambda s, d: combos.attach_etf(fx.combo(s, d).select("symbol"), _etf_map(s, d), _fund_scores(s, d, 1), _fund_scores(s, d, 2)))

_CUST = "c_mktsegment <> 'BUILDING'"
query("universe_eligible", o.sql(f"SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal AS market_cap, c_name AS name, c_mktsegment AS sector, c_mktsegment AS industry, CAST(NULL AS VARCHAR) AS sub_industry FROM customer WHERE {_CUST} AND c_acctbal >= 1000"))(
    lambda s, d: combos.eligible(
        fx.table(s, d, "customer").select(
            F.col("c_custkey").cast("string").alias("symbol"), F.expr(_CUST).alias("has_options"), F.col("c_acctbal").alias("market_cap"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("c_mktsegment").alias("industry"), F.lit(None).cast("string").alias("sub_industry")
        ),
        1000.0,
    )
)
# ---- desk
_RULES = ["lower_spy_qqq_vol_ma_ratio between 0.05 and 0.2", "middle_wyckoff_stage >= 0", "upper_wyckoff_stage is not null"]
query("screen_rules", o.sql(f"SELECT symbol, lower_spy_qqq_vol_ma_ratio, middle_wyckoff_stage FROM combo WHERE {' AND '.join(_RULES)} ORDER BY lower_spy_qqq_vol_ma_ratio DESC, middle_wyckoff_stage, symbol LIMIT 50", "combo"))(
    lambda s, d: desk.run_screen(fx.combo(s, d).select("symbol", "lower_spy_qqq_vol_ma_ratio", "middle_wyckoff_stage", "upper_wyckoff_stage"), _RULES, ["symbol", "middle_wyckoff_stage", "-lower_spy_qqq_vol_ma_ratio"], 50).drop("upper_wyckoff_stage")
)


def _scored(s, d) -> DataFrame:
    return scoring.score_combo(fx.combo(s, d), scoring.futures_base)


_SUMMARY = "printf('%.1f / %.1f', l, s)"
query("view_sorted", o.sql(f"SELECT symbol, sig AS signal, l AS mtf_long_score, s AS mtf_short_score, {_SUMMARY} AS score_summary, lower_ttm_squeeze_pro FROM fb WHERE sig = 'long'", "combo", extra=_FUTURES))(
    lambda s, d: desk.view(_scored(s, d), "long", ["symbol", "signal", "mtf_long_score", "mtf_short_score", "score_summary", "lower_ttm_squeeze_pro", "absent"])
)
query(
    "view_nested",
    o.sql("SELECT symbol, lower_ttm_squeeze_pro AS l, middle_wyckoff_stage AS m, upper_wyckoff_stage AS u FROM combo", "combo"),
)(lambda s, d: desk.nest_roles(fx.combo(s, d)).select("meta.symbol", F.col("lower.ttm_squeeze_pro").alias("l"), F.col("middle.wyckoff_stage").alias("m"), F.col("upper.wyckoff_stage").alias("u")))


def _cell(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} = floor({c}) THEN printf('%d', CAST({c} AS BIGINT)) ELSE printf('%.2f', {c}) END"


query(
    "inspect_unpivot",
    o.sql(
        f"SELECT 'wyckoff_stage' AS field, '—' AS lower, {_cell('middle_wyckoff_stage')} AS middle, {_cell('upper_wyckoff_stage')} AS upper FROM combo WHERE symbol = '7' UNION ALL SELECT 'spy_qqq_vol_ma_ratio', {_cell('lower_spy_qqq_vol_ma_ratio')}, {_cell('middle_spy_qqq_vol_ma_ratio')}, '—' FROM combo WHERE symbol = '7'",
        "combo",
    ),
)(lambda s, d: desk.inspect(fx.combo(s, d), "7", ["wyckoff_stage", "spy_qqq_vol_ma_ratio"]))
query("score_tier", o.sql("SELECT symbol, CASE WHEN l >= 6 THEN 'strong' WHEN l >= 4 THEN 'mild' ELSE 'none' END AS tier FROM base", "combo", extra=_PRIOR))(lambda s, d: _scored(s, d).select("symbol", tx.score_tier(F.col("mtf_long_score")).alias("tier")))
query(
    "health_coverage",
    o.sql(
        "SELECT 'customers' AS name, 'nonempty' AS \"check\", count(*) > 0 AS ok, count(*) AS found FROM combo UNION ALL SELECT 'orders', 'coverage', count(*) = 0, count(*) FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS s FROM customer EXCEPT SELECT DISTINCT CAST(o_custkey AS VARCHAR) FROM orders)",
        "combo",
    ),
)(
    lambda s, d: desk.check_nonempty(fx.combo(s, d), "customers").unionByName(
        desk.check_coverage(fx.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol")), fx.combo(s, d), "orders")
    )
)
_DIGEST = f"{_FUTURES}, dg AS (SELECT signal, string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE r <= 40) AS symbols, count(*) AS n, greatest(count(*) - 40, 0) AS overflow FROM (SELECT sig AS signal, symbol, row_number() OVER (PARTITION BY sig ORDER BY symbol) AS r FROM fb WHERE sig <> 'none') GROUP BY signal)"
query("alert_digest", o.sql("SELECT signal, symbols, n, CAST(overflow AS BIGINT) AS overflow FROM dg", "combo", extra=_DIGEST))(lambda s, d: desk.alert_digest(_scored(s, d)))
_ALL = "SELECT sha256(string_agg(signal || ':' || symbols, '|' ORDER BY list_position(['long', 'short', 'watch', 'anti'], signal))) AS fingerprint FROM (SELECT sig AS signal, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM fb WHERE sig <> 'none' GROUP BY sig)"
query("alert_fingerprint", o.sql(_ALL, "combo", extra=_FUTURES))(lambda s, d: desk.fingerprint(_scored(s, d)))
query("alert_fingerprint_rows", o.sql("SELECT '[' || string_agg('[\"' || symbol || '\",\"' || sig || '\",\"' || sig || '\"]', ',' ORDER BY symbol, sig) || ']' AS fingerprint FROM fb WHERE sig <> 'none'", "combo", extra=_FUTURES))(lambda s, d: desk.fingerprint_rows(_scored(s, d)))
query(
    "alert_rows",
    o.sql("SELECT * FROM (SELECT sig AS signal, symbol, sig AS side, l AS long, s AS short, row_number() OVER (PARTITION BY sig ORDER BY symbol) AS place, count(*) OVER (PARTITION BY sig) AS n, greatest(count(*) OVER (PARTITION BY sig) - 75, 0) AS overflow FROM fb WHERE sig <> 'none') WHERE place <= 75", "combo", extra=_FUTURES),
)(lambda s, d: desk.alert_rows(_scored(s, d)))


def _digests(s, d, where: str) -> DataFrame:
    return fx.table(s, d, "orders").filter(where).groupBy(F.col("o_orderpriority").alias("alert_key")).agg(F.md5(F.count(F.lit(1)).cast("string")).alias("fingerprint"))


query(
    "alert_changed",
    o.sql(
        "SELECT n.alert_key, n.fingerprint FROM (SELECT o_orderpriority AS alert_key, md5(CAST(count(*) AS VARCHAR)) AS fingerprint FROM orders GROUP BY 1) n LEFT JOIN (SELECT o_orderpriority AS alert_key, md5(CAST(count(*) AS VARCHAR)) AS fingerprint FROM orders WHERE o_orderpriority < '3' OR o_orderstatus = 'O' GROUP BY 1) s USING (alert_key) WHERE n.fingerprint IS DISTINCT FROM s.fingerprint"
    ),
)(lambda s, d: desk.changed_only(_digests(s, d, "true"), _digests(s, d, "o_orderpriority < '3' or o_orderstatus = 'O'").withColumn("saved_at", F.lit("2024-01-01"))))
query(
    "diff_symbols",
    o.sql(
        "SELECT symbol, 'entered' AS change FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'O') UNION ALL SELECT symbol, 'exited' FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol FROM orders WHERE o_orderstatus <> 'O' EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O')"
    ),
)(lambda s, d: desk.diff_symbols(*[fx.table(s, d, "orders").filter(f"o_orderstatus {x} 'O'").select(F.col("o_custkey").cast("string").alias("symbol")) for x in ("=", "<>")]))
query("combo_asof", o.sql("SELECT max(ts) AS asof FROM h1", "h1"))(lambda s, d: desk.combo_asof(combos.build_combo(*_ladder(s, d))))
query("qa_sample", o.sql("SELECT symbol, etf_symbol_primary FROM em ORDER BY md5(symbol || '|42'), symbol LIMIT 50", extra=_MATCH))(lambda s, d: desk.qa_sample(_etf_map(s, d)).select("symbol", "etf_symbol_primary"))
@query("stream_bars", o.sql(f"SELECT {BARS} FROM h1", "h1"))
def stream_bars(s, d):
    """The events table read as a stream to its end, forming hourly bars; equals the batch."""
    import uuid

    from ..streaming.forming import forming_bars, into_table, newest

    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    source = fx.table(s, d, "events")
    t = s.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = t.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))
    q = into_table(forming_bars(t), f"{path}/bars", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return newest(s, f"{path}/bars")


from . import driver_queries, table_queries  # noqa: E402, F401  they register theirs

"""Registered queries over whole pipelines: timeframes, cascades, combos, trends, universe, health, alerts, late ticks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.resample import fold_bars, fold_ticks, resample_weekly
from ..sources import bars as src
from ..sources.scratch import shared_dir
from ..streaming.forming import forming_bars, forming_bars_with_stubs, into_table, newest
from . import config, loading, pipelines
from . import fixtures as fx
from . import oracle as o
from .queries import _FUTURES, _MATCH, _MID, _OPTIONS, _TH, BARS, PX, _fund_scores, _fund_sql, _funds, _scored, _side, _stocks, exh_ctes, exh_sql, guard_sql, macdv_sql, query, sigvol_sql, squeeze_sql, trend_sql, wyckoff_sql
from .table_queries import fresh

# ---- timeframes
_CUT = "SELECT {b} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ({src})) WHERE r <= {n}"
_WEEK, _MONTH = (o.fold("{}", f"date_trunc('{u}', ts)", label="t") for u in ("week", "month"))
#: What the bars of a timeframe are before they are cut to the window, and what that needs.
_WHOLE = {
    ("stocks", "daily"): ("SELECT * FROM d1", "d1"),
    ("stocks", "weekly"): (_WEEK.format("d1"), "d1"),
    ("stocks", "monthly"): (_MONTH.format("d1"), "d1"),
    ("stocks", "intraday_4h"): (o.fold("h1", o.B4), "h1"),
    ("futures", "intraday_1h"): ("SELECT * FROM h1", "h1"),
    ("futures", "intraday_4h"): (o.fold("h1", o.B4), "h1"),
    ("futures", "daily"): (o.fold("h1", o.TRADE_DATE, "hour(ts) <> 17"), "h1"),
}


def _ratio_sql(length: int) -> str:
    """Benchmarks are the two first symbols, with all their bars; every symbol has ``length`` bars or more."""
    mean = lambda least: f"CASE WHEN count(volume) {o.over(length)} >= {least} THEN avg(volume) {o.over(length)} END"
    own = mean(f"greatest(4, least({length}, bars) // 2) AND bars >= 4")
    two = f"SELECT symbol, ts, {mean(f'greatest(3, {length} // 2)')} AS m FROM whole_in WHERE symbol IN (SELECT DISTINCT symbol FROM whole_in ORDER BY symbol LIMIT 2)"
    return f"SELECT symbol, n.ts, round(own / nullif(b, 0), 6) AS v FROM (SELECT symbol, ts, {own} AS own FROM nb) n LEFT JOIN (SELECT ts, CASE WHEN count(m) = 2 THEN min(m) END AS b FROM ({two}) GROUP BY ts) m ON n.ts = m.ts"


def _instance_sql(i) -> str:
    p = i.params
    return {
        "wyckoff_stage": lambda: wyckoff_sql(p["fast"], p["inter"], p["slow"]),
        "exh_abs_price_action": lambda: exh_sql(p["z"]),
        "significant_volume": lambda: sigvol_sql(p["lookback"], p["z"]),
        "spy_qqq_volume_ma_ratio": lambda: _ratio_sql(p["length"]),
        "movingavg_trend_bullish": lambda: trend_sql(True, p["displace"], p["length"]),
        "movingavg_trend_bearish": lambda: trend_sql(False, p["displace"], p["length"]),
        "macdv_core_bullish": lambda: macdv_sql(True, p["z"]),
        "macdv_core_bearish": lambda: macdv_sql(False, p["z"]),
        "macdv_guard": lambda: guard_sql(p["z"]),
        "ttm_squeeze_pro": lambda: squeeze_sql(p["z"]),
    }[i.id]()


def _profile_sql(select: str, keys: list[str], namespace: str = "stocks", timeframe: str = "daily") -> str:
    """``select`` over the last bars ``b`` of a timeframe and one table of values for each key."""
    instances = {i.key: i for i in config.DEFAULT.profile(namespace, timeframe)}
    whole, need = _WHOLE[namespace, timeframe]
    look = next(i.params["lookback"] for i in instances.values() if i.id == "exh_abs_price_action")
    fast = next(i.params["fast"] for i in instances.values() if i.id == "wyckoff_stage")
    parts = ", ".join(f"k_{k} AS ({_instance_sql(instances[k])})" for k in keys)
    joins = " ".join(f"JOIN k_{k} USING (symbol, ts)" for k in keys)
    extra = f"whole_in AS ({whole}), {exh_ctes(look)}, last_bar AS ({_CUT.format(b='* EXCLUDE (r)', src='SELECT * FROM bars_in', n=1)}), {parts}"
    cut = _CUT.format(b="* EXCLUDE (r)", src=whole, n=config.WINDOWS[namespace, timeframe])
    return o.sql(f"SELECT {select} FROM last_bar b {joins}", "mv", extra=extra, bars="bars_in", vma=fast, made=cut, of=(need,))


def _keys(namespace: str, timeframe: str) -> list[str]:
    return [i.key for i in config.DEFAULT.profile(namespace, timeframe)]


def _snapshot_sql(namespace: str, timeframe: str, more: str = "") -> str:
    keys = _keys(namespace, timeframe)
    return _profile_sql(f"{more}symbol, ts, {', '.join(f'b.{c}' for c in PX)}, {', '.join(f'k_{k}.v AS {k}' for k in keys)}", keys, namespace, timeframe)


def _two(df: DataFrame) -> tuple[str, str]:
    """The two first symbols, which stand for the benchmarks."""
    return tuple(r["symbol"] for r in df.select("symbol").distinct().orderBy("symbol").limit(2).collect())


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("spy_qqq_vol_ma_ratio", F.round("spy_qqq_vol_ma_ratio", 6))


@query("snapshot_daily_profile", _snapshot_sql("stocks", "daily"))
def snapshot_daily_profile(s, d):
    daily = fx.daily(s, d)
    both = daily.filter(F.col("symbol").isin(*_two(daily)))
    return _shown(pipelines.snapshot(pipelines.run_timeframe(daily, "stocks", "daily", benchmarks=both), "stocks", "daily"))


def _tail(src_: str, n: int, name: str) -> str:
    return f"SELECT '{name}' AS timeframe, {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ({src_})) WHERE r <= {n}"


def _bars(steps: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tf, df in steps.items():
        part = df.select(F.lit(tf).alias("timeframe"), *BARS.split(", "))
        out = part if out is None else out.unionByName(part)
    return out


_SESSION = o.fold("h1", o.TRADE_DATE, "hour(ts) <> 17")
query("cascade_futures_1h", o.sql(" UNION ALL ".join([_tail("SELECT * FROM h1", 16_000, "intraday_1h"), _tail(o.fold("h1", o.B4), 250, "intraday_4h"), _tail(_SESSION, 260, "daily")]), "h1"))(
    lambda s, d: _bars(pipelines.cascade({"intraday_1h": fx.hourly(s, d)}, "futures", "intraday_1h"))
)
query("cascade_futures_daily", o.sql(" UNION ALL ".join([_tail("SELECT * FROM sd", 20, "daily"), _tail(_WEEK.format("sd"), 20, "weekly"), _tail(_MONTH.format("sd"), 20, "monthly")]), "h1", extra=f"sd AS ({_SESSION})"))(
    lambda s, d: _bars(pipelines.cascade({"intraday_1h": fx.hourly(s, d)}, "futures", "daily", 20))
)
query("cascade_stocks_daily", o.sql(" UNION ALL ".join([_tail("SELECT * FROM d1", 260, "daily"), _tail(_WEEK.format("d1"), 210, "weekly"), _tail(_MONTH.format("d1"), 250, "monthly")]), "d1"))(
    lambda s, d: _bars(pipelines.cascade({"daily": fx.daily(s, d)}, "stocks", "daily"))
)
_UP = [o.fold("mo", f"date_trunc('{u}', ts)::TIMESTAMP") for u in ("quarter", "year")]
query("cascade_stocks_monthly", o.sql(" UNION ALL ".join([_tail("SELECT * FROM mo", 250, "monthly"), _tail(_UP[0], 200, "quarterly"), _tail(_UP[1], 200, "yearly")]), "d1", extra=f"mo AS ({_MONTH.format('d1')})"))(
    lambda s, d: _bars(pipelines.cascade({"daily": fx.daily(s, d)}, "stocks", "monthly"))
)
_CASCADE_130 = [_tail(o.fold("m15", o.B130, f"{o.MOD} BETWEEN 570 AND 960"), 300, "intraday_130m"), _tail("SELECT * FROM d1", 260, "daily"), _tail(_WEEK.format("d1"), 210, "weekly")]
query("cascade_stocks_130m", o.sql(" UNION ALL ".join(_CASCADE_130), "m15", "d1"))(
    lambda s, d: _bars(pipelines.cascade({"intraday_5m": fx.minutes(s, d, 15), "daily": fx.daily(s, d)}, "stocks", "intraday_130m"))
)



def _cascade_sql(namespace: str, timeframe: str) -> str:
    """The last bars of a cascade with their indicators; what a timeframe does not have is NULL."""
    tfs = [timeframe, *config.CASCADE[namespace, timeframe]]
    every = list(dict.fromkeys(k for tf in tfs for k in _keys(namespace, tf)))
    parts = []
    for tf in tfs:
        keys = _keys(namespace, tf)
        values = ", ".join(f"k_{k}.v AS {k}" if k in keys else f"CAST(NULL AS DOUBLE) AS {k}" for k in every)
        parts.append(f"SELECT * FROM ({_profile_sql(f"'{tf}' AS timeframe, symbol, ts, {', '.join(f'b.{c}' for c in PX)}, {values}", keys, namespace, tf)})")
    return " UNION ALL ".join(parts)


def _cascade_rows(made: dict[str, DataFrame], namespace: str) -> DataFrame:
    out = None
    for tf, df in made.items():
        part = _shown(pipelines.snapshot(df, namespace, tf)).withColumn("timeframe", F.lit(tf))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query("cascade_snapshots_stocks", _cascade_sql("stocks", "daily"))
def cascade_snapshots_stocks(s, d):
    """Days, and weeks and months rolled up from them in one pass, with all indicators and two benchmarks."""
    daily = fx.daily(s, d)
    return _cascade_rows(pipelines.cascade({"daily": daily}, "stocks", "daily", benchmarks=_two(daily)), "stocks")


@query("cascade_snapshots_futures", _cascade_sql("futures", "intraday_1h"))
def cascade_snapshots_futures(s, d):
    hourly = fx.hourly(s, d)
    return _cascade_rows(pipelines.cascade({"intraday_1h": hourly}, "futures", "intraday_1h", benchmarks=_two(hourly)), "futures")


def _ratios_sql(tf: str) -> str:
    length = next(i.params["length"] for i in config.DEFAULT.profile("stocks", tf) if i.key == "spy_qqq_vol_ma_ratio")
    whole, need = _WHOLE["stocks", tf]
    cut = _CUT.format(b="* EXCLUDE (r)", src=whole, n=config.WINDOWS["stocks", tf])
    return f"SELECT '{tf}' AS timeframe, symbol, ts, v FROM ({o.sql(_ratio_sql(length), 'nb', extra=f'whole_in AS ({whole})', bars='bars_in', made=cut, of=(need,))})"


@query("cascade_ratios_stocks", " UNION ALL ".join(map(_ratios_sql, ("daily", "weekly", "monthly"))))
def cascade_ratios_stocks(s, d):
    """The volume ratio of every bar of a cascade; where a benchmark has no bar of that time there is none."""
    daily = fx.daily(s, d)
    made = pipelines.cascade({"daily": daily}, "stocks", "daily", benchmarks=_two(daily))
    parts = [df.select(F.lit(tf).alias("timeframe"), "symbol", "ts", F.round("spy_qqq_vol_ma_ratio", 6).alias("v")) for tf, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OLD = "SELECT symbol, ts, open, high, low, close + 5 AS close, adj_close, volume FROM ({}) WHERE ts < TIMESTAMP '1998-01-01'"
_NEW = "SELECT * FROM ({}) WHERE ts >= TIMESTAMP '1997-01-01'"
_UPSERTED = "SELECT '{tf}' AS timeframe, {b} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM (SELECT * FROM ({new}) UNION ALL SELECT * FROM ({old}) o WHERE NOT EXISTS (SELECT 1 FROM ({new}) n WHERE n.symbol = o.symbol AND n.ts = o.ts))) WHERE r <= 2000"


@query(
    "cascade_into_stored",
    o.sql(" UNION ALL ".join(_UPSERTED.format(tf=tf, b=BARS, new=fold.format("recent_d"), old=_OLD.format(fold.format("d1"))) for tf, fold in (("daily", "SELECT * FROM {}"), ("weekly", _WEEK), ("monthly", _MONTH))), "d1", extra=f"recent_d AS ({_NEW.format('SELECT * FROM d1')})"),
)
def cascade_into_stored(s, d):
    """The bars of the last years go over stored ones that overlap them, in every timeframe of the cascade."""
    daily = fx.daily(s, d)
    stored = {tf: df.filter("ts < timestamp_ntz'1998-01-01'").withColumn("close", F.col("close") + 5) for tf, df in {"daily": daily, **{tf: pipelines.bars_of({"daily": daily}, "stocks", tf) for tf in ("weekly", "monthly")}}.items()}
    return _bars(pipelines.cascade({"daily": daily.filter("ts >= timestamp_ntz'1997-01-01'")}, "stocks", "daily", 2000, old=stored))


# ---- load steps: quarter hours of ticks, some negative, stand for the vendor's bars
_NOW = {"stocks": datetime(2024, 1, 20, 15, 40), "futures": datetime(2024, 1, 18, 15, 40)}
_DIRTY15 = "dirty15 AS (" + o.fold_ticks("time_bucket(INTERVAL 15 MINUTES, ts)", "(SELECT symbol, ts, id, CASE WHEN id % 97 = 0 THEN -price ELSE price END AS price FROM ticks)") + "), names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM ticks))"


def _vendor_sql(day: str) -> str:
    """The first symbol has no fine bars, the second and third have none of the forming bars; every fifth day is missing."""
    return f"""{_DIRTY15}, base_in AS (SELECT {BARS} FROM dirty15 WHERE day(ts) % 5 <> 0 AND ts < TIMESTAMP '{day} 14:30:00'),
 fine_in AS (SELECT {BARS} FROM dirty15 JOIN names USING (symbol) WHERE ts >= TIMESTAMP '{day}' - INTERVAL 2 DAYS AND ts < TIMESTAMP '{day} 15:40:00' AND k <> 1 AND (k > 3 OR ts < TIMESTAMP '{day} 13:00:00')),
 hours_in AS ({o.fold("base_in", "date_trunc('hour', ts)")})"""


def _vendor(s, d, now: datetime) -> tuple[DataFrame, DataFrame]:
    t = fx.ticks(s, d).withColumn("price", F.when(F.col("id") % 97 == 0, -F.col("price")).otherwise(F.col("price")))
    bars = fold_ticks(t, F.window("ts", "15 minutes").start)
    names = t.select("symbol").distinct().withColumn("k", F.row_number().over(Window.orderBy("symbol")))  # five symbols
    at = lambda h, m=0: F.lit(now.replace(hour=h, minute=m)).cast("timestamp_ntz")
    fine = bars.join(names, "symbol").filter((F.col("ts") >= at(0) - F.expr("INTERVAL 2 DAYS")) & (F.col("ts") < at(15, 40)) & (F.col("k") != 1) & ((F.col("k") > 3) | (F.col("ts") < at(13)))).drop("k")
    return bars.filter((F.dayofmonth("ts") % 5 != 0) & (F.col("ts") < at(14, 30))), fine


_STOCKS_4H = f"""{_vendor_sql('2024-01-20')}, {o.mended('hours_in', 'hours_ok', 20)}, {o.mended('fine_in', 'fine_ok', 20)}, {o.formed('hours_ok', 'fine_ok', 'hours_now', '2024-01-20 15:00:00', 1)},
 fours AS ({o.fold('hours_now', o.B4)}), {o.gridded('fours', 'on_grid')}, {o.formed('on_grid', 'fine_ok', 'fours_now', '2024-01-20 13:00:00', 4)}"""
query("load_stocks_4h", o.sql(f"SELECT {BARS} FROM fours_now", "ticks", extra=_STOCKS_4H))(lambda s, d: loading.stocks_4h(*_vendor(s, d, _NOW["stocks"]), _NOW["stocks"], 20.0))
_FUTURES_4H = f"""{_vendor_sql('2024-01-18')}, {o.formed('hours_in', 'fine_in', 'hours_now', '2024-01-18 15:00:00', 1)}, fours AS ({o.fold('hours_now', o.B4)}), {o.formed('fours', 'fine_in', 'fours_now', '2024-01-18 13:00:00', 4)}"""
query("load_futures_1h", o.sql(f"SELECT {BARS} FROM hours_now", "ticks", extra=_FUTURES_4H))(lambda s, d: pipelines.load(dict(zip(("intraday_1h", "recent"), _vendor(s, d, _NOW["futures"]), strict=True)), "futures", "intraday_1h", _NOW["futures"]))
query("load_futures_4h", o.sql(f"SELECT {BARS} FROM fours_now", "ticks", extra=_FUTURES_4H))(lambda s, d: pipelines.load(dict(zip(("intraday_1h", "recent"), _vendor(s, d, _NOW["futures"]), strict=True)), "futures", "intraday_4h", _NOW["futures"]))
query("load_futures_closed", o.sql(f"SELECT {BARS} FROM ({o.fold('hours_in', o.B4)})", "ticks", extra=_vendor_sql("2024-01-20")))(
    # a Saturday: the session is closed, so nothing forms
    lambda s, d: pipelines.load(dict(zip(("intraday_1h", "recent"), _vendor(s, d, _NOW["stocks"]), strict=True)), "futures", "intraday_4h", _NOW["stocks"])
)


def _eod_sql(fold: str) -> str:
    """Derived bars of the last days, and the vendor's by calendar day for all symbols, of which only the short ones take any."""
    own, vendor = (f"SELECT *, {p} AS p FROM ({fold.format(src)})" for src, p in (("own_d", 1), ("vendor_d", 0)))
    derived = o.fold("(SELECT * FROM h1 WHERE symbol > 'e' OR ts >= TIMESTAMP '2024-01-20')", o.TRADE_DATE, "hour(ts) <> 17")
    days = o.fold("h1", "date_trunc('day', ts)::TIMESTAMP")
    both = f"SELECT * FROM own_b UNION ALL SELECT * FROM vendor_b WHERE symbol NOT IN (SELECT symbol FROM own_b GROUP BY symbol HAVING count(*) >= 15)"
    one = f"SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY p DESC) AS r FROM ({both})"
    return o.sql(
        f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS q FROM ({one}) WHERE r = 1) WHERE q <= 15",
        "h1",
        extra=f"own_d AS ({derived}), vendor_d AS (SELECT symbol, ts, open, high, low, close + 1 AS close, adj_close, volume FROM ({days})), own_b AS ({own}), vendor_b AS ({vendor})",
    )


def _eod(timeframe: str):
    def run(s, d):
        h = fx.hourly(s, d)
        stored = h.filter((F.col("symbol") > "e") | (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")))
        days = fold_bars(h, F.to_date("ts").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
        vendor = days if timeframe == "daily" else resample_weekly(days)
        return pipelines.load({"intraday_1h": stored, timeframe: vendor}, "futures", timeframe, _NOW["futures"], 15)

    return run


query("load_futures_daily", _eod_sql("SELECT * FROM {}"))(_eod("daily"))
query("load_futures_weekly", _eod_sql(_WEEK))(_eod("weekly"))


_SPLIT = "2024-01-15 00:00:00"


def _holes(df: DataFrame) -> DataFrame:
    return df.withColumn("high", F.when(F.hour("ts") != 3, F.col("high")))


@query(
    "timeframe_upsert",
    o.sql(
        f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM (SELECT symbol, ts, open, CASE WHEN hour(ts) <> 3 THEN high END AS high, low, close, adj_close, volume FROM h1 WHERE ts >= TIMESTAMP '{_SPLIT}' UNION ALL SELECT symbol, ts, open, high, low, close + 5, adj_close, volume FROM h1 WHERE ts < TIMESTAMP '{_SPLIT}')) WHERE r <= 400 AND high IS NOT NULL",
        "h1",
    ),
)
def timeframe_upsert(s, d):
    """New futures bars, some without a high, over stored ones that overlap them and have a pivot's columns."""
    h = fx.hourly(s, d)
    old = h.withColumns({"close": F.col("close") + 5, "('open', 'aapl')": F.lit(1.0)})
    new = _holes(h).filter(F.col("ts") >= F.lit(_SPLIT).cast("timestamp_ntz"))
    return pipelines.run_timeframe(new, "futures", "intraday_1h", 400, old).select(*BARS.split(", "))


# ---- combos
def _loud(low: str) -> str:
    return " OR ".join(o.yes(f"({v} = 2 AND {r} > {_TH}) OR ({v} = 1 AND {r} > 0.25)") for v, r in ((_MID, "middle_spy_qqq_vol_ma_ratio"), (low, "lower_spy_qqq_vol_ma_ratio")))


def _combo_sql(c: config.Combo) -> str:
    """The score of one configured combo over the table ``combo``."""
    pattern = scoring.tf_pattern(*c.timeframes())
    bar = "current" if c.namespace == "stocks" and pattern in ("daily-weekly-monthly", "weekly-monthly-quarterly") else "prior"
    exh, low = f"lower_exh_abs_pa_{bar}_bar", f"lower_sig_vol_{bar}_bar"
    points = f"(SELECT *, {_side(True, exh)} AS l, {_side(False, exh)} AS s FROM combo)"
    if c.namespace == "stocks":
        base = f"(SELECT *, CASE WHEN s >= 4 THEN 'short' WHEN l >= 4 THEN 'long' ELSE 'none' END AS sig, CASE WHEN {_loud(low)} THEN 1.0 ELSE 0.0 END AS b FROM {points})"
        if c.universe == "shortlist_stocks":
            return f"SELECT '{c.name}' AS combo, symbol, sig AS signal, l + b AS long, s + b AS short FROM {base}"
        el, es = (f"CASE WHEN coalesce({', '.join(e)}) IS NOT NULL THEN greatest({', '.join(f'coalesce({x}, 0)' for x in e)}) END" for e in ([f"etf_{t}_{r}_{w}_score" for t in ("lower", "middle") for r in ("primary", "secondary")] for w in ("long", "short")))
        cut = f"(SELECT *, CASE WHEN sig = 'long' AND l + b < 5 OR sig = 'short' AND s + b < 5 THEN 'none' ELSE sig END AS c, {el} AS el, {es} AS es FROM {base})"
        guarded = f"CASE WHEN c = 'long' AND {o.yes('es >= 4')} OR c = 'short' AND {o.yes('el >= 4')} THEN 'anti' WHEN c = 'long' AND {o.yes('el < 4')} OR c = 'short' AND {o.yes('es < 4')} THEN 'watch' ELSE c END"
        return f"SELECT '{c.name}' AS combo, symbol, {guarded} AS signal, l + b AS long, s + b AS short FROM {cut}"
    base = f"(SELECT *, CASE WHEN l >= 4 THEN 'long' WHEN s >= 4 THEN 'short' ELSE 'none' END AS sig FROM {points})"
    volumes = {"intraday_4h-daily-weekly": [_MID], "daily-weekly-monthly": [_MID, low]}.get(pattern)
    if volumes is None:
        return f"SELECT '{c.name}' AS combo, symbol, sig AS signal, l AS long, s AS short FROM {base}"
    some, much = (" OR ".join(o.yes(f"{v} {op}") for v in volumes) for op in (">= 1", "= 2"))
    live = "sig <> 'none' AND upper_wyckoff_stage IS NOT NULL"
    with_b = f"(SELECT *, CASE WHEN {live} AND ({some}) THEN 1.0 ELSE 0.0 END + CASE WHEN {live} AND ({much}) THEN 1.0 ELSE 0.0 END AS b FROM {base})"
    return f"SELECT '{c.name}' AS combo, symbol, CASE WHEN sig = 'long' AND l + b < 5 OR sig = 'short' AND s + b < 5 THEN 'none' ELSE sig END AS signal, l + b AS long, s + b AS short FROM {with_b}"


@query("score_all_combos", o.sql(" UNION ALL ".join(_combo_sql(c) for c in config.DEFAULT.combos) + " UNION ALL SELECT 'unknown', symbol, 'none', 0.0, 0.0 FROM combo", "combo"))
def score_all_combos(s, d):
    """Every configured combo routed to its rule, and one of an unknown universe."""
    out = None
    for c in [*config.DEFAULT.combos, config.Combo("unknown", "stocks", "daily", "weekly", "monthly", "nobody")]:
        rule = scoring.route(c.namespace, c.universe, scoring.tf_pattern(*c.timeframes()))
        part = scoring.score_combo(fx.combo(s, d), *rule).select(F.lit(c.name).alias("combo"), "symbol", "signal", F.col("mtf_long_score").alias("long"), F.col("mtf_short_score").alias("short"))
        out = part if out is None else out.unionByName(part)
    return out


def _signals_sql(c: config.Combo) -> str:
    """The three timeframes' last bars with their indicators, joined and scored."""
    roles = [(r, tf, _keys(c.namespace, tf)) for r, tf in zip(config.ROLES, c.timeframes(), strict=True)]
    columns = ", ".join(f"{r}_.{k} AS {r}_{k}" for r, _, keys in roles for k in keys)
    tables = " JOIN ".join(f"({_snapshot_sql(c.namespace, tf)}) {r}_" + (" USING (symbol)" if r != "lower" else "") for r, tf, _ in roles)
    return f"WITH combo AS (SELECT symbol, {columns} FROM {tables}) {_combo_sql(c)}"


def _signals(name: str, bars: str, base: str):
    cfg = next(c for c in config.DEFAULT.combos if c.name == name)

    def run(s, d):
        source = getattr(fx, bars)(s, d)
        scored = pipelines.run_signals({base: source}, cfg, source.select("symbol"), benchmarks=_two(source))
        return scored.select(F.lit(name).alias("combo"), "symbol", "signal", F.col("mtf_long_score").alias("long"), F.col("mtf_short_score").alias("short"))

    query(f"signals_from_{bars}", _signals_sql(cfg))(run)


_signals("stocks_c_dwm_shortlist", "daily", "daily")
_signals("futures_1_1h4hd_shortlist", "hourly", "intraday_1h")


def _snapshots(s, d) -> dict[str, DataFrame]:
    c = fx.combo(s, d)
    when = {"lower": "2024-01-03", "middle": "2024-01-02", "upper": "2024-01-01"}
    role = lambda r: c.select("symbol", F.lit(when[r]).cast("timestamp_ntz").alias("ts"), *[F.col(x).alias(x[len(r) + 1 :]) for x in c.columns if x.startswith(f"{r}_")])
    return dict(zip(("intraday_4h", "weekly", "quarterly"), map(role, config.ROLES), strict=True))


_ATTACHED = f"""{_MATCH}, raw_combo AS (SELECT * FROM combo), chosen AS (SELECT r.* EXCLUDE ({', '.join(f'etf_{t}_{r}_{w}_score' for t in ('lower', 'middle') for r in ('primary', 'secondary') for w in ('long', 'short'))}),
  a.l AS etf_lower_primary_long_score, a.s AS etf_lower_primary_short_score, b.l AS etf_middle_primary_long_score, b.s AS etf_middle_primary_short_score,
  x.l AS etf_lower_secondary_long_score, x.s AS etf_lower_secondary_short_score, y.l AS etf_middle_secondary_long_score, y.s AS etf_middle_secondary_short_score
 FROM raw_combo r LEFT JOIN em m USING (symbol) LEFT JOIN {_fund_sql(1)} a ON a.e = m.etf_symbol_primary LEFT JOIN {_fund_sql(2)} b ON b.e = m.etf_symbol_primary
 LEFT JOIN {_fund_sql(1)} x ON x.e = m.etf_symbol_secondary LEFT JOIN {_fund_sql(2)} y ON y.e = m.etf_symbol_secondary
 WHERE symbol IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)), """
_RULE = _OPTIONS.replace("FROM combo", "FROM chosen")


@query(
    "combo_pipeline",
    o.sql(
        f"SELECT symbol, TIMESTAMP '2024-01-03' AS lower_date, TIMESTAMP '2024-01-01' AS upper_date, CASE WHEN c = 'long' AND {o.yes('es >= 4')} THEN 'anti' WHEN c = 'short' AND {o.yes('el >= 4')} THEN 'anti' WHEN c = 'long' AND {o.yes('el < 4')} THEN 'watch' WHEN c = 'short' AND {o.yes('es < 4')} THEN 'watch' ELSE c END AS signal, l + bonus AS mtf_long_score, s + bonus AS mtf_short_score, '2024-01-05T00-00-00' AS asof FROM cut",
        "combo",
        extra=_ATTACHED + _RULE,
    ),
)
def combo_pipeline(s, d):
    """Three snapshots joined, restricted, given their ETF context, scored, stored, and read from the history."""
    cfg = config.Combo("c", "stocks", "intraday_4h", "weekly", "quarterly", "options_eligible")
    universe = fx.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"))
    etf = (pipelines.combos.match_by_tokens(_stocks(s, d), _funds(s, d)), _fund_scores(s, d, 1), _fund_scores(s, d, 2))
    path = fresh(s)
    pipelines.store_combo(pipelines.run_combo(_snapshots(s, d), cfg, universe, etf), path, cfg, datetime(2024, 1, 5))
    return src.read_combo_asof(s, path, "stocks", "c").select("symbol", "lower_date", "upper_date", "signal", "mtf_long_score", "mtf_short_score", "asof")


# ---- ETF trends
_TRENDS = ", ".join(f"CASE WHEN {o.yes(f'k_wyckoff_stage.v = {2 * n}')} THEN 4.0 ELSE 0.0 END + CASE WHEN {o.yes(f'k_macdv_guard.v = {2 * n}')} THEN 2.0 ELSE 0.0 END AS etf_{w}_score" for n, w in ((1, "long"), (-1, "short")))


def _etfs(s, d) -> DataFrame:
    return fx.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.min("o_orderkey").alias("pos"))


query("etf_trends_daily", _profile_sql(f"symbol AS etf_symbol, {_TRENDS}", ["wyckoff_stage", "macdv_guard"]))(lambda s, d: pipelines.etf_trends(fx.daily(s, d), "daily", _etfs(s, d)))


@query("etf_scores_stored", o.sql("SELECT 'weekly' AS timeframe, e AS etf_symbol, l AS etf_long_score, s AS etf_short_score FROM " + _fund_sql(1) + " UNION ALL SELECT 'daily', e, l, s FROM " + _fund_sql(2), extra=_MATCH))
def etf_scores_stored(s, d):
    """Scores of one timeframe are stored and read, those of another are made."""
    path = fresh(s)
    pipelines.store_etf_trends(_fund_scores(s, d, 1), path, "weekly")
    made = lambda: _fund_scores(s, d, 2)
    return _tagged_scores(pipelines.etf_scores(s, path, "weekly", made), "weekly").unionByName(_tagged_scores(pipelines.etf_scores(s, path, "daily", made), "daily"))


def _tagged_scores(df: DataFrame, timeframe: str) -> DataFrame:
    return df.select(F.lit(timeframe).alias("timeframe"), "etf_symbol", "etf_long_score", "etf_short_score")


# ---- universe, health, alerts
@query(
    "universe_pipeline",
    o.sql(
        "SELECT c.symbol, c.market_cap, em.etf_symbol_primary, em.etf_symbol_secondary FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS market_cap FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_type <> 'SMALL' AND p_brand <> 'Brand#2' AND p_retailprice >= 910) c JOIN em USING (symbol)",
        extra=_MATCH,
    ),
)
def universe_pipeline(s, d):
    """Listed symbols less exclusions that are eligible, with their ETFs."""
    p = fx.table(s, d, "part")
    key = F.col("p_partkey").cast("string").alias("symbol")
    listed = fx.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"))
    half = listed.filter(F.length("symbol") > 2)
    meta = p.select(key, (F.col("p_type") != "SMALL").alias("has_options"), F.col("p_retailprice").alias("market_cap"), F.col("p_brand").alias("name"), F.col("p_type").alias("sector"), F.col("p_name").alias("industry"), F.lit(None).cast("string").alias("sub_industry"))
    chosen, etf_map = pipelines.build_universe([listed, half], p.filter("p_brand = 'Brand#2'").select(key), meta, _funds(s, d), min_cap=910.0)
    return chosen.select("symbol", "market_cap").join(etf_map.select("symbol", "etf_symbol_primary", "etf_symbol_secondary"), "symbol")


query(
    "health_run",
    o.sql(
        """SELECT 'customers' AS name, 'nonempty' AS "check", TRUE AS ok, count(*) AS found FROM combo UNION ALL SELECT 'customers', 'coverage', TRUE, 0 UNION ALL SELECT 'none', 'nonempty', FALSE, 0
 UNION ALL SELECT 'none', 'coverage', count(*) = 0, count(*) FROM combo UNION ALL SELECT 'orders', 'nonempty', count(*) > 0, count(*) FROM orders
 UNION ALL SELECT 'orders', 'coverage', count(*) = 0, count(*) FROM (SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders)""",
        "combo",
    ),
)(
    lambda s, d: pipelines.run_health(
        {"customers": (c := fx.combo(s, d), c), "none": (c.limit(0), c), "orders": (fx.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol")), c)}
    )
)


@query(
    "alerts_run",
    o.sql("SELECT 'first' AS run, 'k' AS alert_key, sig AS signal, string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE r <= 40) AS symbols, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY symbol) AS r FROM fb WHERE sig <> 'none') GROUP BY sig UNION ALL SELECT 'changed', 'k', sig, string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE r <= 40), count(*) FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY symbol) AS r FROM fb WHERE sig <> 'none' AND symbol <> (SELECT max(symbol) FROM fb WHERE sig = 'long')) GROUP BY sig", "combo", extra=_FUTURES),
)
def alerts_run(s, d):
    """Three runs: with no state, with the same symbols (silent), and with one symbol less, beyond what the digest shows."""
    scored = _scored(s, d)
    state = s.createDataFrame([], "alert_key string, fingerprint string, saved_at string")
    first, row = pipelines.run_alerts(scored, "k", state, "1")
    state = state.unionByName(row)
    same, _ = pipelines.run_alerts(scored, "k", state, "2")
    last = scored.filter("signal = 'long'").agg(F.max("symbol").alias("top"))
    less = scored.join(last, F.col("symbol") == F.col("top"), "left_anti")
    changed, _ = pipelines.run_alerts(less, "k", state, "3")
    out = None
    for name, df in (("first", first), ("same", same), ("changed", changed)):
        part = df.select(F.lit(name).alias("run"), "alert_key", "signal", "symbols", "n")
        out = part if out is None else out.unionByName(part)
    return out


# ---- late ticks
_LATE = "id % 50 = 7"


@query(
    "stream_late_ticks",
    o.sql(f"SELECT {BARS} FROM ({o.fold_ticks("date_trunc('hour', ts)", 'kept')})", "ticks", extra=f"kept AS (SELECT * FROM ticks WHERE NOT ({_LATE}) OR date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM ticks WHERE NOT ({_LATE})) - INTERVAL 10 MINUTES)"),
)
def stream_late_ticks(s, d):
    """Two batches: most ticks, then those that came late, of which only the ones of windows still open count."""
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    t = fx.table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))
    for part, rows in (("a", t.filter(f"not ({_LATE})")), ("b", t.filter(_LATE))):
        rows.write.parquet(f"{path}/in/part={part}")
        stream = s.readStream.schema(t.schema).parquet(f"{path}/in/part=*")
        q = into_table(forming_bars(stream), f"{path}/bars", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return newest(s, f"{path}/bars")


_STUBBED = """mark AS (SELECT max(ts) - INTERVAL 10 MINUTES AS m FROM ticks), hours AS (SELECT symbol, unnest(generate_series(min(ts), greatest(max(ts), date_trunc('hour', (SELECT m FROM mark))), INTERVAL 1 HOUR)) AS ts FROM h1 GROUP BY symbol),
 whole AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM hours LEFT JOIN h1 USING (symbol, ts))"""


@query("stream_stubs", o.sql(f"SELECT symbol, ts, {', '.join(f'coalesce({x}, c) AS {x}' for x in PX[:5])}, coalesce(volume, 0.0) AS volume FROM whole", "h1", extra=_STUBBED))
def stream_stubs(s, d):
    """The events as a stream to its end, with a stub for every hour in which a symbol falls silent."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(store)
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    source = fx.table(s, d, "events")
    t = s.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = t.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = into_table(forming_bars_with_stubs(t), f"{path}/bars", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        s.conf.set(store, before)
    return newest(s, f"{path}/bars")

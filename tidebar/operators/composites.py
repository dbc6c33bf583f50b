"""Composite indicators: ordinal codes from window primitives and recursive series.

Each function takes a frame that has bars, ``rn`` (bar number) and ``bars``
(bars of the symbol) and returns it with one more column.  ``NEEDS`` names the
recursive series, which the registry asks the kernel for in one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import pmax, pmin, yes
from . import frames as f
from .kernel import Series


def vma_weight(n: int) -> Column:
    """Weight of the adaptive mean: 2/(n+1) times the share by which ups and downs differ."""
    ups, downs = f.rsum("_up", n), f.rsum("_down", n)
    return F.coalesce(F.lit(2.0 / (n + 1)) * F.abs(F.try_divide(ups - downs, ups + downs)), F.lit(0.0))


def needs_wyckoff(fast: int, **_) -> list[Series]:
    return [Series(f"vma_{fast}", "vma", "close", fast, by=f"vma_w_{fast}")]


def wyckoff_stage(df: DataFrame, out: str, fast: int, inter: int, slow: int) -> DataFrame:
    c, vma = F.col("close"), F.col(f"vma_{fast}")
    df = df.withColumns({"_f": f.vwma(fast), "_i": f.vwma(inter), "_s": f.vwma(slow), "_v1": f.lag(vma)})
    accel = yes(c > vma) & yes(F.col("_f") > F.col("_i")) & yes(F.col("_i") > F.col("_s"))
    decel = yes(c < vma) & yes(F.col("_f") < F.col("_i")) & yes(F.col("_i") < F.col("_s"))
    code = F.when(accel, 2.0).when(decel, -2.0).when(yes(vma > F.col("_v1")), 1.0).when(yes(vma < F.col("_v1")), -1.0).otherwise(0.0)
    return df.withColumn(out, F.when(F.col("bars") >= max(fast, inter, slow), code)).drop("_f", "_i", "_s", "_v1")


def body_weight() -> Column:
    """How much of a bar its body is: (100 body) to the power of body / range, 0 without a range."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    return F.when(span == 0, 0.0).otherwise(F.pow(body * 100.0, F.try_divide(body, span)))


def needs_exh(lookback: int = 126, **_) -> list[Series]:
    return [Series(f"pct_body_{lookback}", "pctrank", "body_weight", lookback), *needs_volume_rank(lookback)]


def needs_volume_rank(lookback: int = 126, **_) -> list[Series]:
    return [Series(f"pct_volume_{lookback}", "pctrank", "volume", lookback)]


def exh_abs_price_action(df: DataFrame, out: str, floor=33.0, ceiling=67.0, lookback=126, scan=2, check=1, wick=0.5, strict=False, z=0) -> DataFrame:
    """Exhaustion and absorption: +-1 pin bars, +-2 engulfing bars; z = 1 asks the next bar to confirm."""
    own = [F.col(f"`{x}`") for x in df.columns]
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns({"_mx": pmax(o, c), "_mn": pmin(o, c), "_hh": f.rmax("high", scan), "_ll": f.rmin("low", scan)})
    lags = {f"_{n}{k}": f.lag(n if n[0] != "_" else F.col(n), k) for n in ("_mx", "_mn") for k in (1, 2, 3)}
    lags |= {f"_{n}1": f.lag(n) for n in ("open", "close", "high", "low")} | {f"{n}{k}": f.lag(F.col(n), k) for n in ("_hh", "_ll") for k in (1, 2)}
    df = df.withColumns({"_cp": F.col(f"pct_body_{lookback}"), "_vp": F.col(f"pct_volume_{lookback}")} | lags)
    g = F.col
    exh = yes((floor - F.floor(g("_vp"))) + (floor - F.floor(g("_cp"))) >= 0)
    absorb = yes((F.ceil(g("_vp")) - ceiling) + (floor - F.floor(g("_cp"))) >= 0)
    top_check, bot_check = (g("_mn"), g("_mx")) if strict else (g("_mx"), g("_mn"))
    n_top = sum((yes(top_check >= g(f"__mx{k}")).cast("int") for k in (1, 2, 3)), F.lit(0)) >= check
    n_bot = sum((yes(bot_check <= g(f"__mn{k}")).cast("int") for k in (1, 2, 3)), F.lit(0)) >= check
    pin_top = (exh | absorb) & yes(h >= g("_hh1")) & n_top & yes(h - g("_mx") > wick * (g("_mn") - low))
    pin_bot = (exh | absorb) & yes(low <= g("_ll1")) & n_bot & yes(g("_mn") - low > wick * (h - g("_mx")))
    o1, c1, h1, l1 = g("_open1"), g("_close1"), g("_high1"), g("_low1")
    eng_top = (yes(h >= g("_hh1")) | yes(h1 >= g("_hh2"))) & n_top & yes(o >= c1) & yes(c < o1) & yes(o > c) & yes(o1 <= c1) & (yes(o >= h1) | yes(c <= l1))
    eng_bot = (yes(low <= g("_ll1")) | yes(l1 <= g("_ll2"))) & n_bot & yes(o <= c1) & yes(c > o1) & yes(o < c) & yes(o1 >= c1) & (yes(o <= l1) | yes(c >= h1))
    if z == 0:
        code = F.when(eng_top, -2.0).when(pin_top, -1.0).when(eng_bot, 2.0).when(pin_bot, 1.0).otherwise(0.0)
        df = df.withColumn(out, code)
    elif z == 1:
        df = df.withColumns({"_pt": pin_top, "_pb": pin_bot, "_et": eng_top, "_eb": eng_bot})
        df = df.withColumns({f"_{n}1": yes(f.lag(F.col(f"_{n}"))) for n in ("pt", "pb", "et", "eb")})
        code = (
            F.when(g("_et1") & yes(o <= c1) & yes(low < l1), -2.0)
            .when(g("_pt1") & yes(h <= h1), -1.0)
            .when(g("_eb1") & yes(o >= c1) & yes(h > h1), 2.0)
            .when(g("_pb1") & yes(low >= l1), 1.0)
            .otherwise(0.0)
        )
        df = df.withColumn(out, code)
    else:
        df = df.withColumn(out, F.lit(0.0))
    return df.select(*own, out)


def significant_volume(df: DataFrame, out: str, lookback=126, floor=33.0, ceiling=67.0, z=0) -> DataFrame:
    df = df.withColumn("_p", F.ceil(F.col(f"pct_volume_{lookback}")))
    df = df.withColumns({"_p0": f.lag(F.col("_p"), z), "_p1": f.lag(F.col("_p"), z + 1)})
    either = lambda t: yes(F.col("_p0") >= t) | yes(F.col("_p1") >= t)
    return df.withColumn(out, F.when(either(ceiling), 2.0).when(either(floor), 1.0).otherwise(0.0)).drop("_p", "_p0", "_p1")


def volume_ma_ratio(df: DataFrame, out: str, length: int, benchmarks: DataFrame) -> DataFrame:
    """Own volume mean over the lesser benchmark volume mean at the same bar.

    A symbol with fewer than ``length`` bars is held against benchmark means of
    its own number of bars, so means are made for each number that occurs
    (``length`` at most).  ``benchmarks``: bars of two symbols, a few thousand
    rows that the timeframe's window bounds.
    """
    own = df.withColumn("_own", f.sma_adaptive("volume", length)).withColumn("_win", F.least(F.lit(length), F.col("bars")))
    wins = df.select(F.least(F.lit(length), F.col("bars")).cast("long").alias("_win")).distinct()
    w = f.Window.partitionBy("symbol", "_win").orderBy("ts")
    b = benchmarks.select("symbol", "ts", "volume").withColumn("_win", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long")))).join(wins, "_win", "left_semi")
    b = b.withColumn("_n", F.row_number().over(w))
    prior = F.collect_list("volume").over(w.rowsBetween(-(length - 1), 0))
    part = F.slice(prior, -F.least(F.size(prior), F.col("_win")).cast("int"), F.least(F.size(prior), F.col("_win")).cast("int"))
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    b = b.withColumn("_m", F.when(F.col("_n") >= F.greatest(F.lit(3), F.floor(F.col("_win") / 2)), mean))
    both = b.groupBy("_win", "ts").agg(F.min("_m").alias("_least"), F.count("_m").alias("_k")).select("_win", "ts", F.when(F.col("_k") == 2, F.col("_least")).alias("_bench"))
    return own.join(both, ["_win", "ts"], "left").withColumn(out, F.try_divide("_own", F.nullif("_bench", F.lit(0.0)))).drop("_own", "_win", "_bench")


def needs_trend(length: int, displace: int = 0, **_) -> list[Series]:
    source = "close" if not displace else f"close_{displace}"
    return [Series(f"ema_{source}_{length}", "ema", source, length), Series(f"wilder_{source}_{length}", "wilder", source, length)]


def _trend(df: DataFrame, length: int, displace: int):
    source = "close" if not displace else f"close_{displace}"
    return F.col(f"ema_{source}_{length}"), df.withColumn("_sma", f.sma(source, length)), F.col(f"wilder_{source}_{length}")


def movingavg_trend_bullish(df: DataFrame, out: str, length: int, displace: int = 0) -> DataFrame:
    ema, df, wilder = _trend(df, length, displace)
    s = F.col("_sma")
    return df.withColumn(out, F.when(yes(ema > wilder) & yes(s > wilder), 2.0).when(yes(ema > s), 1.0).otherwise(0.0)).drop("_sma")


def movingavg_trend_bearish(df: DataFrame, out: str, length: int, displace: int = 0) -> DataFrame:
    ema, df, wilder = _trend(df, length, displace)
    s = F.col("_sma")
    return df.withColumn(out, F.when(yes(ema < wilder) & yes(s < wilder), -2.0).when(yes(ema < s), -1.0).otherwise(0.0)).drop("_sma")


def needs_macdv(**_) -> list[Series]:
    return [
        Series("ema_close_12", "ema", "close", 12),
        Series("ema_close_26", "ema", "close", 26),
        Series("atr_26", "wilder", "tr", 26),
        Series("macdv", "macdv", "ema_close_12", by="ema_close_26", over="atr_26"),
        Series("macdv_signal", "ema", "macdv", 9),
    ]


def _macdv_lags(df: DataFrame, z: int) -> tuple[DataFrame, list[Column], list[Column]]:
    df = df.withColumns({f"_{n}{k}": f.lag(F.col(s), z + k) for n, s in (("m", "macdv"), ("s", "macdv_signal")) for k in (0, 1, 2)})
    return df, [F.col(f"_m{k}") for k in (0, 1, 2)], [F.col(f"_s{k}") for k in (0, 1, 2)]


def _drop_lags(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_{n}{k}" for n in "ms" for k in (0, 1, 2)])


def _strong_bull(m, s, k, t):
    return yes(pmax(m[k], m[k + 1]) > t) & yes(m[k] > s[k]) & yes(s[k] > s[k + 1])


def _strong_bear(m, s, k, t):
    return yes(pmin(m[k], m[k + 1]) < -t) & yes(m[k] < s[k]) & yes(s[k] < s[k + 1])


def macdv_core_bullish(df: DataFrame, out: str, z: int = 0, threshold: float = 45.0) -> DataFrame:
    df, m, s = _macdv_lags(df, z)
    d = [a - b for a, b in zip(m, s, strict=True)]
    weak = yes(pmax(m[0], m[1]) > threshold) | yes(m[0] > s[0]) & yes(s[0] > s[1]) | yes(d[0] > d[1]) & yes(d[1] > d[2])
    strong = _strong_bull(m, s, 0, threshold) | _strong_bull(m, s, 1, threshold)
    return _drop_lags(df.withColumn(out, F.when(strong, 2.0).when(weak, 1.0).otherwise(0.0)))


def macdv_core_bearish(df: DataFrame, out: str, z: int = 0, threshold: float = 45.0) -> DataFrame:
    df, m, s = _macdv_lags(df, z)
    d = [a - b for a, b in zip(m, s, strict=True)]
    weak = yes(pmin(m[0], m[1]) < -threshold) | yes(m[0] < s[0]) & yes(s[0] < s[1]) | yes(d[0] < d[1]) & yes(d[1] < d[2])
    strong = _strong_bear(m, s, 0, threshold) | _strong_bear(m, s, 1, threshold)
    return _drop_lags(df.withColumn(out, F.when(strong, -2.0).when(weak, -1.0).otherwise(0.0)))


def macdv_guard(df: DataFrame, out: str, z: int = 0, threshold: float = 45.0) -> DataFrame:
    df, m, s = _macdv_lags(df, z)
    return _drop_lags(df.withColumn(out, F.when(_strong_bull(m, s, 0, threshold), 2.0).when(_strong_bear(m, s, 0, threshold), -2.0).otherwise(0.0)))


def needs_squeeze(length: int = 20, **_) -> list[Series]:
    return [Series(f"ema_close_{length}", "ema", "close", length), Series(f"atr_{length}", "wilder", "tr", length)]


def keltner(length: int, factor: float) -> tuple[Column, Column]:
    mid, width = F.col(f"ema_close_{length}"), factor * F.col(f"atr_{length}")
    return mid - width, mid + width


def ttm_squeeze_pro(df: DataFrame, out: str, length: int = 20, strict: bool = True, z: int = 0) -> DataFrame:
    lower, upper = f.bollinger("close", length)
    df = df.withColumns({"_lb": lower, "_ub": upper, "_delta": F.col("close") - (f.donchian(length) + f.sma("close", length)) / 2})
    dot = F.lit(False)
    for factor in (1.0, 1.5, 2.0):
        lo, hi = keltner(length, factor)
        inside, above = yes(F.col("_ub") < hi), yes(F.col("_lb") > lo)
        dot = dot | (inside & above if strict else inside | above)
    df = df.withColumns({"_dot": dot, "_dp": f.linreg("_delta", length)})
    df = df.withColumns({f"_d{k}": f.lag(F.col("_dp"), z + k) for k in (0, 1, 2)} | {"_sq": yes(f.lag(F.col("_dot"), z))})
    d0, d1, d2 = (F.col(f"_d{k}") for k in (0, 1, 2))
    rising, falling = yes(d0 > d1) | yes(d1 > d2), yes(d0 < d1) | yes(d1 < d2)
    code = F.when(rising & falling | F.col("_sq"), 0.0).when(falling, -1.0).when(rising, 1.0)
    return df.withColumn(out, F.when(F.col("bars") >= length, code)).drop("_lb", "_ub", "_delta", "_dot", "_dp", "_d0", "_d1", "_d2", "_sq")


def needs_rsi(n: int = 14) -> list[Series]:
    return [Series(f"gain_{n}", "wilder", "_gain", n), Series(f"loss_{n}", "wilder", "_loss", n)]


def rsi(n: int = 14) -> Column:
    """Wilder's index from the means of ``needs_rsi``; the first difference counts as 0, and 100 where nothing was lost."""
    gain, loss = F.col(f"gain_{n}"), F.col(f"loss_{n}")
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))


def entry_signal(trend: str, regime: str, trend_min: float, max_vol: float = 0.0) -> Column:
    return (yes(F.col(trend) >= trend_min) & yes(F.col(regime) <= max_vol)).cast("double")

"""Combo scores as CASE expressions over role-prefixed snapshot columns, made step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import yes


def _c(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _points(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1.0).otherwise(0.0) for c in conditions), F.lit(0.0))


def _with_points(df: DataFrame, exh: str) -> DataFrame:
    """``_long`` and ``_short``: the four points of each side (regime, cloud, exhaustion, momentum).

    What later steps use more than once is a column, not an expression that each
    use repeats: repeated, the rules grow to code that the JVM only interprets.
    """
    up, up_exh = _c(df, "upper_wyckoff_stage"), _c(df, "upper_exh_abs_pa_prior_bar")
    mid, mid_exh = _c(df, "middle_wyckoff_stage"), _c(df, "middle_exh_abs_pa_prior_bar")
    squeeze, bull, bear, low = _c(df, "lower_ttm_squeeze_pro"), _c(df, "lower_macdv_core_bull"), _c(df, "lower_macdv_core_bear"), _c(df, exh)
    long = _points(
        [
            F.when(up.isNotNull(), yes(up > 0) | yes(up_exh > 0)).otherwise(yes(mid > 0) | yes(mid_exh > 0)),
            yes(_c(df, "lower_ma_trend_bullish") > 0),
            yes(low.isin(1.0, 2.0)),
            yes(bull == 2) | yes(bull == 1) & yes(squeeze >= 0),
        ]
    )
    short = _points(
        [
            F.when(up.isNotNull(), yes(up < 0) | yes(up_exh < 0)).otherwise(yes(mid < 0) | yes(mid_exh < 0)),
            yes(_c(df, "lower_ma_trend_bearish") < 0),
            yes(low.isin(-1.0, -2.0)),
            yes(bear == -2) | yes(bear == -1) & yes(squeeze <= 0),
        ]
    )
    return df.withColumns({"_long": long, "_short": short})


def _plus(df: DataFrame, signal: Column, bonus: Column) -> DataFrame:
    """The signal of the bare points as ``_signal``, then the bonus on both sides."""
    out = df.withColumns({"_signal": signal, "_bonus": bonus})
    return out.withColumns({"_long": F.col("_long") + F.col("_bonus"), "_short": F.col("_short") + F.col("_bonus")}).drop("_bonus")


def _cut() -> Column:
    """The signal where its side has five points."""
    signal = F.col("_signal")
    return F.when((signal == "long") & (F.col("_long") < 5), "none").when((signal == "short") & (F.col("_short") < 5), "none").otherwise(signal)


def stocks_shortlist(df: DataFrame, exh: str, sigvol: str) -> DataFrame:
    """Short overrides long at four points each; volume then adds a point to both scores."""
    signal = F.when(F.col("_short") >= 4, "short").when(F.col("_long") >= 4, "long").otherwise("none")
    known = _c(df, "upper_wyckoff_stage").isNotNull()
    loud = F.lit(False)
    for vol, ratio in ((_c(df, "middle_sig_vol_current_bar"), _c(df, "middle_spy_qqq_vol_ma_ratio")), (_c(df, sigvol), _c(df, "lower_spy_qqq_vol_ma_ratio"))):
        loud = loud | yes(vol == 2) & yes(ratio > F.when(known, 0.05).otherwise(0.10)) | yes(vol == 1) & yes(ratio > 0.25)
    return _plus(_with_points(df, exh), signal, F.when(loud, 1.0).otherwise(0.0))


def etf_score(*columns: Column) -> Column:
    """Greatest of the scores with NULL as 0; NULL where all are."""
    return F.when(F.coalesce(*columns).isNotNull(), F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in columns]))


def _etf_side(df: DataFrame, side: str) -> Column:
    return etf_score(*[_c(df, f"etf_{tf}_{rank}_{side}_score") for tf in ("lower", "middle") for rank in ("primary", "secondary")])


def stocks_options(df: DataFrame, exh: str, sigvol: str) -> DataFrame:
    """The shortlist score cut at five points, then held against the ETF trend where that is known."""
    out = stocks_shortlist(df, exh, sigvol).withColumns({"_signal": _cut(), "_etf_long": _etf_side(df, "long"), "_etf_short": _etf_side(df, "short")})
    cut, etf_long, etf_short = F.col("_signal"), F.col("_etf_long"), F.col("_etf_short")
    guarded = (
        F.when((cut == "long") & yes(etf_short >= 4), "anti")
        .when((cut == "short") & yes(etf_long >= 4), "anti")
        .when((cut == "long") & yes(etf_long < 4), "watch")
        .when((cut == "short") & yes(etf_short < 4), "watch")
        .otherwise(cut)
    )
    return out.withColumn("_signal", guarded).drop("_etf_long", "_etf_short")


def futures_base(df: DataFrame, exh: str, sigvol: str) -> DataFrame:
    return _with_points(df, exh).withColumn("_signal", F.when(F.col("_long") >= 4, "long").when(F.col("_short") >= 4, "short").otherwise("none"))


def _with_volume(df: DataFrame, exh: str, sigvol: str, volumes: list[Column]) -> DataFrame:
    base = futures_base(df, exh, sigvol)
    live = F.col("_signal").isin("long", "short") & _c(df, "upper_wyckoff_stage").isNotNull()
    some, much = F.lit(False), F.lit(False)
    for v in volumes:
        some, much = some | yes(v >= 1), much | yes(v == 2)
    bonus = F.when(live & some, 1.0).otherwise(0.0) + F.when(live & much, 1.0).otherwise(0.0)
    return _plus(base, F.col("_signal"), bonus).withColumn("_signal", _cut())


def futures_4h_d_w(df: DataFrame, exh: str, sigvol: str) -> DataFrame:
    return _with_volume(df, exh, sigvol, [_c(df, "middle_sig_vol_current_bar")])


def futures_d_w_m(df: DataFrame, exh: str, sigvol: str) -> DataFrame:
    return _with_volume(df, exh, sigvol, [_c(df, "middle_sig_vol_current_bar"), _c(df, sigvol)])


def route(namespace: str, universe: str, pattern: str):
    """(evaluator or None, exhaustion column, volume column) of a combo."""
    bar = "current" if namespace == "stocks" and pattern in ("daily-weekly-monthly", "weekly-monthly-quarterly") else "prior"
    columns = f"lower_exh_abs_pa_{bar}_bar", f"lower_sig_vol_{bar}_bar"
    if namespace == "futures":
        by = {"intraday_4h-daily-weekly": futures_4h_d_w, "daily-weekly-monthly": futures_d_w_m}
        return (by.get(pattern, futures_base), *columns)
    return ({"shortlist_stocks": stocks_shortlist, "options_eligible": stocks_options}.get(universe), *columns)


def tf_pattern(lower: str, middle: str, upper: str) -> str:
    return f"{lower}-{middle}-{upper}"


def score_combo(combo: DataFrame, evaluator, exh: str = "lower_exh_abs_pa_prior_bar", sigvol: str = "lower_sig_vol_prior_bar") -> DataFrame:
    """Add signal, signal_side and both scores; with no evaluator none, 0 and 0 and no side."""
    if evaluator is None:
        return combo.withColumns({"signal": F.lit("none"), "mtf_long_score": F.lit(0.0), "mtf_short_score": F.lit(0.0)})
    out = evaluator(combo, exh, sigvol)
    return out.withColumns({"signal": F.col("_signal"), "signal_side": F.col("_signal"), "mtf_long_score": F.col("_long"), "mtf_short_score": F.col("_short")}).drop("_signal", "_long", "_short")


def etf_trend(snapshot: DataFrame, volume_column: str = "significant_volume") -> DataFrame:
    """(etf_symbol, etf_long_score, etf_short_score), the first row of each symbol by ``pos``, or by the scores where there is none.

    ``volume_column`` is absent from snapshots by default, so its point is off;
    it gives a point to both sides where it is exactly 1.
    """
    stage, guard, volume = _c(snapshot, "wyckoff_stage"), _c(snapshot, "macdv_guard"), _c(snapshot, volume_column)
    loud = F.when(yes(volume == 1.0), 1.0).otherwise(0.0)
    side = lambda s: F.when(yes(stage == 2 * s), 4.0).otherwise(0.0) + F.when(yes(guard == 2 * s), 2.0).otherwise(0.0) + loud
    pos = F.col("pos") if "pos" in snapshot.columns else F.lit(0)
    scored = snapshot.select(F.col("symbol").alias("etf_symbol"), F.struct(pos.alias("pos"), side(1).alias("etf_long_score"), side(-1).alias("etf_short_score")).alias("r"))
    return scored.groupBy("etf_symbol").agg(F.min("r").alias("r")).select("etf_symbol", "r.etf_long_score", "r.etf_short_score")

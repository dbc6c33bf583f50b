"""Compositions: timeframe, cascade, combo, ETF trends, universe, health, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import bucket_4h, bucket_130m, in_regular_session, not_maintenance, trade_date
from ..operators import combos, desk, scoring
from ..operators.frames import latest, tail_bars
from ..operators.registry import apply_profile
from ..operators.repair import upsert_window, valid_ohlc
from ..operators.rollup import Calendar, rollup
from ..sources.bars import drop_legacy, snapshot_columns, union_listings, write_combo
from . import config, loading


def _of(unit: str, day: Callable[[Column], Column] = lambda t: t) -> Callable[[Column], Column]:
    return lambda t: F.trunc(F.to_date(day(t)), unit)


def _days(timeframe: str, unit: str, first: bool = True) -> Calendar:
    """Weeks and longer over daily or longer bars, labelled by their first bar or by their start."""
    return Calendar(timeframe, _of(unit), (lambda t: t) if first else None)


def _sessions(timeframe: str, unit: str | None = None) -> Calendar:
    """Trade dates, or what is made of them, over hourly bars."""
    return Calendar(timeframe, _of(unit, trade_date) if unit else trade_date, trade_date if unit else None, not_maintenance)


#: Where bars come from that are not given: the calendar over each base, the nearest first.
CALENDARS: dict[tuple[str, str], dict[str, Calendar]] = {
    ("futures", "intraday_4h"): {"intraday_1h": Calendar("intraday_4h", bucket_4h)},
    ("futures", "daily"): {"intraday_1h": _sessions("daily")},
    ("futures", "weekly"): {"daily": _days("weekly", "week"), "intraday_1h": _sessions("weekly", "week")},
    ("futures", "monthly"): {"daily": _days("monthly", "month"), "intraday_1h": _sessions("monthly", "month")},
    ("stocks", "intraday_130m"): {"intraday_5m": Calendar("intraday_130m", bucket_130m, None, in_regular_session, True)},
    ("stocks", "intraday_4h"): {"intraday_1h": Calendar("intraday_4h", bucket_4h)},
    ("stocks", "weekly"): {"daily": _days("weekly", "week")},
    ("stocks", "monthly"): {"daily": _days("monthly", "month")},
    ("stocks", "quarterly"): {"monthly": _days("quarterly", "quarter", False), "daily": _days("quarterly", "quarter", False)},
    ("stocks", "yearly"): {"monthly": _days("yearly", "year", False), "daily": _days("yearly", "year", False)},
}
#: Futures bars of these timeframes must have all four prices.
WHOLE_BARS = {("futures", "intraday_1h"), ("futures", "intraday_4h")}


def rolled_bars(sources: dict[str, DataFrame], namespace: str, timeframes: list[str]) -> DataFrame:
    """``timeframe`` and bars of timeframes that are not given, from one pass over each base that is."""
    by: dict[str, list[Calendar]] = {}
    for tf in timeframes:
        base = next((b for b in CALENDARS.get((namespace, tf), ()) if b in sources), None)
        if base is None:
            raise ValueError(f"no bars for {namespace}/{tf}")
        by.setdefault(base, []).append(CALENDARS[namespace, tf][base])
    return reduce(DataFrame.unionByName, [rollup(sources[base], calendars) for base, calendars in by.items()])


def bars_of(sources: dict[str, DataFrame], namespace: str, timeframe: str) -> DataFrame:
    """The bars of a timeframe: given, or folded from what is given."""
    return sources[timeframe] if timeframe in sources else rolled_bars(sources, namespace, [timeframe]).drop("timeframe")


def load(sources: dict[str, DataFrame], namespace: str, timeframe: str, now: datetime, window: int | None = None, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """The new bars of a timeframe by the steps of its source.

    ``sources``: vendor bars by timeframe, and ``recent``, the fine bars that
    forming bars are made of; for daily and longer futures ``intraday_1h`` are
    the stored hourly bars.
    """
    if (namespace, timeframe) == ("stocks", "intraday_4h"):
        return loading.stocks_4h(sources["intraday_1h"], sources["recent"], now)
    if namespace == "futures" and timeframe in ("intraday_1h", "intraday_4h"):
        step = loading.futures_1h if timeframe == "intraday_1h" else loading.futures_4h
        return step(sources["intraday_1h"], sources["recent"], now)
    if namespace == "futures":
        return loading.futures_eod(sources["intraday_1h"], sources[timeframe], timeframe, window or cfg.windows[namespace, timeframe])
    return bars_of(sources, namespace, timeframe)


def run_timeframe(bars: DataFrame, namespace: str, timeframe: str, window: int | None = None, old: DataFrame | None = None, benchmarks: DataFrame | None = None, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """Upsert into the stored bars, cut to the window, then all indicators, over all symbols in one plan.

    Columns that old tables have from pivots go before the upsert; intraday
    futures bars without all four prices go after it.  Recursions start at the
    first bar of the cut window, which bounds what one task holds of a symbol.
    """
    window = window or cfg.windows[namespace, timeframe]
    cut = tail_bars(bars, window) if old is None else upsert_window(bars, drop_legacy(old), window)
    cut = valid_ohlc(cut) if (namespace, timeframe) in WHOLE_BARS else cut
    return apply_profile(cut.repartition("symbol"), cfg.profile(namespace, timeframe), benchmarks)


def snapshot(timeframe_bars: DataFrame, namespace: str, timeframe: str, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """The last bar of each symbol with the configured columns, an error if one is missing."""
    bars = valid_ohlc(timeframe_bars) if (namespace, timeframe) in WHOLE_BARS else timeframe_bars
    return snapshot_columns(latest(bars), [i.key for i in cfg.profile(namespace, timeframe)])


class Cascade(dict):
    """Bars with indicators by timeframe; ``release`` frees the rolled-up bars that they share."""

    rolled: DataFrame | None = None

    def release(self) -> None:
        if self.rolled is not None:
            self.rolled.unpersist()


def cascade(
    sources: dict[str, DataFrame],
    namespace: str,
    timeframe: str,
    window: int | None = None,
    cfg: config.Config = config.DEFAULT,
    old: dict[str, DataFrame] | None = None,
    benchmarks: tuple[str, str] | dict[str, DataFrame] | None = None,
) -> Cascade:
    """The timeframe and those that are brought up to date after it, each from its own whole source, not from cut bars.

    What is not given is rolled up in one pass over its base and cached, so the
    base is read once for all timeframes.  ``old``: stored bars by timeframe, into
    which the new ones are upserted; ``benchmarks``: two symbols among the bars of
    each timeframe, or their bars by timeframe.
    """
    wanted = [timeframe, *config.CASCADE.get((namespace, timeframe), [])]
    out = Cascade()
    if made := [tf for tf in wanted if tf not in sources]:
        out.rolled = rolled_bars(sources, namespace, made).persist()
    for tf in wanted:
        bars = sources[tf] if tf in sources else out.rolled.filter(F.col("timeframe") == tf).drop("timeframe")
        both = benchmarks.get(tf) if isinstance(benchmarks, dict) else bars.filter(F.col("symbol").isin(*benchmarks)) if benchmarks else None
        out[tf] = run_timeframe(bars, namespace, tf, window, (old or {}).get(tf), both, cfg)
    return out


def run_signals(sources: dict[str, DataFrame], combo: config.Combo, universe: DataFrame, etf: tuple[DataFrame, DataFrame, DataFrame] | None = None, benchmarks: tuple[str, str] | dict[str, DataFrame] | None = None, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """From bars to the scored combo: its three timeframes, their snapshots, join and score."""
    lower, *others = combo.timeframes()
    made = cascade(sources, combo.namespace, lower, cfg=cfg, benchmarks=benchmarks)
    for tf in others:
        if tf not in made:
            made |= {tf: run_timeframe(bars_of(sources, combo.namespace, tf), combo.namespace, tf, cfg=cfg)}
    return run_combo({tf: snapshot(made[tf], combo.namespace, tf, cfg) for tf in combo.timeframes()}, combo, universe, etf)


def symbols_for_timeframe(namespace: str, timeframe: str, read: Callable[[str], DataFrame], exclusions: DataFrame, allowed: Iterable[str] | None = None, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """The symbols of all universes that combos of the timeframe name; ``read`` gives a universe by name."""
    names = [u for u in cfg.universes(namespace, timeframe) if allowed is None or u in set(allowed)]
    if not names:
        return exclusions.select("symbol").limit(0)
    return combos.symbols_for({u: read(u) for u in names}, exclusions)


def run_combo(snapshots: dict[str, DataFrame], cfg: config.Combo, universe: DataFrame, etf: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Join, restrict, attach ETF context, score. ``etf``: map, lower scores, middle scores."""
    joined = combos.restrict(combos.build_combo(*(snapshots[tf] for tf in cfg.timeframes())), universe)
    joined = joined if etf is None else combos.attach_etf(joined, *etf, universe=cfg.universe)
    evaluator, exh, sigvol = scoring.route(cfg.namespace, cfg.universe, scoring.tf_pattern(*cfg.timeframes()))
    return scoring.score_combo(joined, evaluator, exh, sigvol)


def store_combo(scored: DataFrame, path: str, cfg: config.Combo, asof: datetime | None = None) -> str:
    """Write a scored combo as the current one and into its history."""
    return write_combo(scored, path, cfg.namespace, cfg.name, asof)


def etf_trends(bars: DataFrame, timeframe: str, etfs: DataFrame, window: int | None = None, cfg: config.Config = config.DEFAULT) -> DataFrame:
    """Trend scores of the listed ETFs (symbol, pos) from their bars."""
    listed = etfs.groupBy("symbol").agg(F.min("pos").alias("pos"))
    ours = bars.join(listed.select("symbol"), "symbol", "left_semi")
    return scoring.etf_trend(latest(run_timeframe(ours, "stocks", timeframe, window, cfg=cfg)).join(listed, "symbol"))


def store_etf_trends(scores: DataFrame, path: str, timeframe: str) -> None:
    scores.write.mode("overwrite").parquet(f"{path}/timeframe={timeframe}")


def etf_scores(spark: SparkSession, path: str, timeframe: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored scores of a timeframe if there are any, else those that ``make()`` gives, which are not stored."""
    try:
        return spark.read.parquet(f"{path}/timeframe={timeframe}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return make()


def build_universe(listings: list[DataFrame], exclusions: DataFrame, meta: DataFrame, etfs: DataFrame, overrides: DataFrame | None = None, min_cap: float = 1e9) -> tuple[DataFrame, DataFrame]:
    """Listed symbols less exclusions that are eligible, and their ETF map."""
    listed = union_listings(*listings).join(exclusions.select("symbol").distinct(), "symbol", "left_anti")
    chosen = combos.eligible(meta.join(listed, "symbol", "left_semi"), min_cap)
    return chosen, combos.match_by_tokens(chosen, etfs, overrides)


def run_health(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """A row for each check of each (combo, expected symbols), failures first."""
    out = None
    for name, (df, expected) in checks.items():
        part = desk.check_nonempty(df, name).unionByName(desk.check_coverage(df, expected, name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("ok", "name", "check")


def run_alerts(scored: DataFrame, alert_key: str, state: DataFrame, saved_at: str, cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """The digest if the alert's symbols differ from the last state (else no rows), and the state row to append then."""
    now = desk.fingerprint(scored).select(F.lit(alert_key).alias("alert_key"), "fingerprint")
    changed = desk.changed_only(now, state)
    tagged = desk.alert_digest(scored, cap).withColumn("alert_key", F.lit(alert_key))
    return tagged.join(changed.select("alert_key"), "alert_key", "left_semi"), changed.withColumn("saved_at", F.lit(saved_at))

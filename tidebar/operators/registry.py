"""Indicator registry: configured instances to one plan.

An instance is (key, id, params).  Sources that several instances share are
made once, recursive series are asked for in one kernel call, then each
composite adds its column.  Unknown ids and missing parameters fail before any
plan is built; an instance that cannot be planned with the values it has been
given (no number for a length, no such column) is NULL, and a warning is logged.
"""

from __future__ import annotations

import inspect
import logging
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import composites as k
from . import frames as f
from .kernel import Series, recursions

REGISTRY = {
    "wyckoff_stage": (k.wyckoff_stage, k.needs_wyckoff),
    "exh_abs_price_action": (k.exh_abs_price_action, k.needs_exh),
    "significant_volume": (k.significant_volume, k.needs_volume_rank),
    "spy_qqq_volume_ma_ratio": (k.volume_ma_ratio, None),
    "movingavg_trend_bullish": (k.movingavg_trend_bullish, k.needs_trend),
    "movingavg_trend_bearish": (k.movingavg_trend_bearish, k.needs_trend),
    "macdv_core_bullish": (k.macdv_core_bullish, k.needs_macdv),
    "macdv_core_bearish": (k.macdv_core_bearish, k.needs_macdv),
    "macdv_guard": (k.macdv_guard, k.needs_macdv),
    "ttm_squeeze_pro": (k.ttm_squeeze_pro, k.needs_squeeze),
}


@dataclass(frozen=True)
class Instance:
    key: str
    id: str
    params: dict = field(default_factory=dict, hash=False)


def validate(instances: list[Instance]) -> None:
    for i in instances:
        if i.id not in REGISTRY:
            raise ValueError(f"unknown indicator {i.id} of {i.key}")
        names = inspect.signature(REGISTRY[i.id][0]).parameters
        if extra := sorted(set(i.params) - set(names)):
            raise ValueError(f"{i.key}: no such parameter {', '.join(extra)}")
        if missing := [n for n, p in names.items() if p.default is p.empty and n not in ("df", "out", "benchmarks", *i.params)]:
            raise ValueError(f"{i.key}: missing {', '.join(missing)}")


def prepared(df: DataFrame, series: list[Series], stretch: str | None = None) -> DataFrame:
    """Bars with numbers and counts, the sources of ``series``, and the series; ``stretch`` as ``recursions`` takes it."""
    base = df.withColumns({"rn": F.row_number().over(f.by_time()), "bars": F.count(F.lit(1)).over(f.whole()), "_up": f.up("close"), "_down": f.down("close"), "tr": f.true_range()})
    weights = {s.by: k.vma_weight(s.n) for s in series if s.kind == "vma"}
    weights |= {c: F.coalesce(F.col(b), F.lit(0.0)) for c, b in (("_gain", "_up"), ("_loss", "_down")) if any(s.source == c for s in series)}
    weights |= {"body_weight": k.body_weight()} if any(s.source == "body_weight" for s in series) else {}
    shifted = {s.source: f.lag("close", int(s.source[6:])) for s in series if s.source.startswith("close_")}
    base = base.withColumns(weights | shifted) if weights | shifted else base
    return recursions(base, series, stretch=stretch) if series else base


def _series_of(instance: Instance) -> list[Series]:
    needs = REGISTRY[instance.id][1]
    series = needs(**instance.params) if needs else []
    if any(not isinstance(s.n, int) for s in series):
        raise TypeError(f"no length: {instance.params}")
    return series


def base_indicators(df: DataFrame) -> DataFrame:
    """Bars with the base set: means of close and volume, RSI, slope of the close, ATR."""
    series = [Series("ema_8", "ema", "close", 8), Series("ema_21", "ema", "close", 21), Series("wema_14", "wilder", "close", 14), Series("atr_14", "wilder", "tr", 14), *k.needs_rsi(14)]
    made = {"sma_8": f.sma("close", 8), "rsi_14": k.rsi(14), "close_slope": f.slope_n("close", 5), "volume_sma_20": f.sma("volume", 20)}
    names = ["sma_8", "ema_8", "ema_21", "wema_14", "rsi_14", "close_slope", "volume_sma_20", "atr_14"]
    return prepared(df, series).withColumns(made).select(*df.columns, *names)


def apply_profile(df: DataFrame, instances: list[Instance], benchmarks: DataFrame | None = None) -> DataFrame:
    """``df`` with a column for each instance, equal keys once; without the OHLCV columns it passes through.

    An instance that fails while the plan is made is NULL throughout.
    """
    if {"open", "high", "low", "close", "volume"} - set(df.columns):
        return df
    wanted = list({i.key: i for i in instances}.values())
    validate(wanted)
    series, failed = [], {}
    for i in wanted:
        try:
            series += _series_of(i)
        except (TypeError, ValueError, ArithmeticError) as e:
            failed[i.key] = e
    out = prepared(df, list(dict.fromkeys(series)))
    for i in wanted:
        try:
            if i.key in failed:
                raise failed[i.key]
            fn = REGISTRY[i.id][0]
            if i.id == "spy_qqq_volume_ma_ratio":
                out = out.withColumn(i.key, F.lit(None).cast("double")) if benchmarks is None else fn(out, i.key, benchmarks=benchmarks, **i.params)
            else:
                out = fn(out, i.key, **i.params)
        except (TypeError, ValueError, ArithmeticError, PySparkException) as e:
            logging.getLogger(__name__).warning("indicator %s (%s) is NULL: %s", i.id, i.key, str(e).split("\n")[0])
            out = out.withColumn(i.key, F.lit(None).cast("double"))
    return out.select(*df.columns, *[i.key for i in wanted])

"""From vendor bars to the bars of a timeframe: each source's steps as one plan over all symbols.

``hourly``: bars at any minutes of the hour; ``recent``: fine bars of the last
days, from which the forming bars are made; ``now``: New York time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.session import in_futures_session
from ..operators.repair import PRICES, dedupe_last, fill_grid, patch_partial, repair_ticks, stitch
from ..operators.resample import BAR, floor_1h, resample_4h, resample_monthly, resample_session_daily, resample_weekly

#: Fixed value: the widest range of a good bar, as a share of its close.
MAX_RANGE = 0.08


def _open(now: datetime) -> Column:
    return in_futures_session(F.lit(now).cast("timestamp_ntz"))


def stocks_4h(hourly: DataFrame, recent: DataFrame, now: datetime, max_range: float = MAX_RANGE, watch: dict[str, Observation] | None = None) -> DataFrame:
    """Whole hours, both sources repaired, the forming hour, four-hour bars on the whole grid, the forming bar.

    ``watch``: for ``hourly`` and ``recent`` an observation that the job which
    uses the bars fills with ``bars_total`` and ``bars_repaired``.
    """
    watch = watch or {}
    hours = repair_ticks(floor_1h(hourly), max_range, watch.get("hourly"))
    fine = repair_ticks(recent, max_range, watch.get("recent")).select(*BAR)
    bars = fill_grid(resample_4h(patch_partial(hours.select(*BAR), fine, now, 1)))
    return patch_partial(bars, fine, now, 4).dropna(how="all", subset=PRICES)


def futures_1h(hourly: DataFrame, recent: DataFrame, now: datetime) -> DataFrame:
    """Whole hours and, while the session is open, the forming hour."""
    return patch_partial(floor_1h(hourly), recent, now, 1, gate=_open(now))


def futures_4h(hourly: DataFrame, recent: DataFrame, now: datetime) -> DataFrame:
    """Four-hour bars of ``futures_1h`` and, while the session is open, the forming one."""
    return patch_partial(resample_4h(futures_1h(hourly, recent, now)), recent, now, 4, gate=_open(now))


def futures_eod(stored_1h: DataFrame, vendor: DataFrame, timeframe: str, window: int) -> DataFrame:
    """Days, weeks or months of the stored hourly bars; symbols that have too few are topped off with vendor bars."""
    folds = {"daily": lambda d: d, "weekly": resample_weekly, "monthly": resample_monthly}
    if timeframe not in folds:
        raise ValueError(f"no such timeframe: {timeframe}")
    one_each = dedupe_last(vendor.select(*BAR).withColumn("_at", F.monotonically_increasing_id()), "_at").drop("_at")
    return stitch(folds[timeframe](resample_session_daily(stored_1h)), one_each, window)

"""One pass over bars to several calendars.

OHLCV states merge (first, greatest, least, last, sum), so every calendar can
be folded from the finest bars themselves.  Each bar is sent to its bucket in
every calendar, states are merged before the exchange, and that one exchange is
by (symbol, timeframe, bucket): a symbol with many bars is not one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import yes
from .resample import BAR, ohlcv


@dataclass(frozen=True)
class Calendar:
    """Buckets of one timeframe, as functions of a bar's time.

    ``label``: bars are labelled by the least of these, else by their bucket;
    ``keep``: which bars count; ``traded``: whether bars without volume or close
    are dropped.
    """

    timeframe: str
    bucket: Callable[[Column], Column]
    label: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None
    traded: bool = False


def rollup(bars: DataFrame, calendars: list[Calendar]) -> DataFrame:
    """``timeframe`` and bars of all calendars, from one scan and one exchange."""
    if not calendars:
        raise ValueError("no calendar")
    sent, t = bars.select("symbol", "ts", *BAR[2:]), F.col("ts")
    for k, c in enumerate(calendars):  # one by one, as a projection may hold one window only
        bucket = c.bucket(t) if c.keep is None else F.when(yes(c.keep(t)), c.bucket(t))
        sent = sent.withColumn(f"_b{k}", bucket.cast("timestamp_ntz")).withColumn(f"_l{k}", (F.col(f"_b{k}") if c.label is None else c.label(t)).cast("timestamp_ntz"))
    place = [F.struct(F.lit(c.timeframe).alias("timeframe"), F.col(f"_b{k}").alias("b"), F.col(f"_l{k}").alias("l")) for k, c in enumerate(calendars)]
    sent = sent.select("symbol", t.alias("_t"), *BAR[2:], F.explode(F.array(*place)).alias("_c")).filter("_c.b is not null")
    out = sent.groupBy("symbol", "_c.timeframe", "_c.b").agg(*ohlcv(), F.min("_c.l").alias("_l"))
    out = out.withColumn("ts", F.col("_l"))  # of a bucket the label is the same throughout
    if traded := [c.timeframe for c in calendars if c.traded]:
        out = out.filter(~F.col("timeframe").isin(traded) | yes(F.col("volume") > 0) & F.col("close").isNotNull())
    return out.select("timeframe", *BAR)

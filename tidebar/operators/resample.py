"""Folding ticks and bars into coarser bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import bucket_130m, bucket_4h, hour_start, in_regular_session, not_maintenance, trade_date

BAR = ["symbol", "ts", "open", "high", "low", "close", "adj_close", "volume"]


def fold_ticks(ticks: DataFrame, bucket: Column) -> DataFrame:
    """Bars from (symbol, ts, price, id); volume counts ticks, ties go by id."""
    return (
        ticks.filter("price is not null")
        .groupBy("symbol", bucket.alias("ts"))
        .agg(
            F.min_by("price", F.struct("ts", "id")).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", F.struct("ts", "id")).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumn("adj_close", F.col("close"))
        .select(*BAR)
    )


def ohlcv() -> list[Column]:
    """First, greatest, least, last and sum, by time; a missing adj_close is the close."""
    return [
        F.min_by("open", "_t").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_t").alias("close"),
        F.max_by(F.coalesce("adj_close", "close"), "_t").alias("adj_close"),
        F.sum("volume").alias("volume"),
    ]


def fold_bars(bars: DataFrame, bucket: Column, label_first: bool = False) -> DataFrame:
    """Coarser bars labelled by their bucket, or by their first bar."""
    out = bars.withColumn("_t", F.col("ts")).groupBy("symbol", bucket.alias("_b")).agg(*ohlcv(), F.min("_t").alias("_first"))
    return out.withColumn("ts", F.col("_first") if label_first else F.col("_b")).select(*BAR)


def floor_1h(bars: DataFrame) -> DataFrame:
    return fold_bars(bars, hour_start(F.col("ts")))


def resample_4h(bars: DataFrame) -> DataFrame:
    """Buckets anchored at 17:00; empty ones do not appear."""
    return fold_bars(bars, bucket_4h(F.col("ts")))


def resample_130m(bars: DataFrame, drop_empty: bool = True) -> DataFrame:
    out = fold_bars(bars.filter(in_regular_session(F.col("ts"))), bucket_130m(F.col("ts")))
    return out.filter("volume > 0 and close is not null") if drop_empty else out


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Any duration that ``window`` takes; bars with a NULL price are dropped."""
    return fold_bars(bars, F.window("ts", rule).start).dropna(how="any", subset=BAR)


def resample_session_daily(bars: DataFrame) -> DataFrame:
    """Hourly bars to trade dates that roll at 18:00, the 17:00 hour left out."""
    return fold_bars(bars.filter(not_maintenance(F.col("ts"))), trade_date(F.col("ts")).cast("timestamp_ntz"))


def _day(unit: str) -> Column:
    return F.trunc(F.to_date("ts"), unit).cast("timestamp_ntz")


def resample_weekly(bars: DataFrame) -> DataFrame:
    """ISO weeks, labelled by their first bar."""
    return fold_bars(bars, _day("week"), label_first=True)


def resample_monthly(bars: DataFrame) -> DataFrame:
    return fold_bars(bars, _day("month"), label_first=True)


def _spined(bars: DataFrame, unit: str, months: int, emit_empty: bool) -> DataFrame:
    out = fold_bars(bars, _day(unit))
    if not emit_empty:
        return out
    ends = out.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = ends.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {months} MONTHS"))).alias("ts"))
    return spine.join(out, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0))).select(*BAR)


def resample_quarterly(bars: DataFrame, emit_empty: bool = False) -> DataFrame:
    return _spined(bars, "quarter", 3, emit_empty)


def resample_yearly(bars: DataFrame, emit_empty: bool = False) -> DataFrame:
    return _spined(bars, "year", 12, emit_empty)

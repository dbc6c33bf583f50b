"""Bars, combos and lists derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import hour_start
from ..operators.resample import fold_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("id"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_ticks(ticks(spark, sf_dir), hour_start(F.col("ts")))


def minutes(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    return fold_ticks(ticks(spark, sf_dir), F.window("ts", f"{width} minutes").start)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("id"))
    return fold_ticks(t, F.to_date("ts").cast("timestamp_ntz"))


#: Codes of a combo: (column, multiplier, offset); missing where the product leaves 6 of 7.
CODES = [
    ("lower_exh_abs_pa_prior_bar", 3, 1), ("lower_exh_abs_pa_current_bar", 5, 2), ("lower_ma_trend_bullish", 11, 1), ("lower_ma_trend_bearish", 13, 3),
    ("lower_macdv_core_bull", 17, 2), ("lower_macdv_core_bear", 19, 4), ("lower_ttm_squeeze_pro", 23, 0), ("lower_sig_vol_prior_bar", 29, 1),
    ("lower_sig_vol_current_bar", 31, 3), ("middle_wyckoff_stage", 37, 2), ("middle_exh_abs_pa_prior_bar", 41, 0), ("middle_sig_vol_current_bar", 43, 1),
    ("upper_wyckoff_stage", 47, 3), ("upper_exh_abs_pa_prior_bar", 53, 2), ("wyckoff_stage", 59, 1), ("macdv_guard", 61, 2), ("significant_volume", 67, 4),
]
#: Ratios and scores: (column, multiplier, divisor); missing where the product leaves 10 of 11.
RATIOS = [("lower_spy_qqq_vol_ma_ratio", 7, 100.0), ("middle_spy_qqq_vol_ma_ratio", 13, 100.0)]
RATIOS += [(f"etf_{tf}_{rank}_{side}_score", m, 5.0) for (tf, rank, side), m in zip([(t, r, s) for t in ("lower", "middle") for r in ("primary", "secondary") for s in ("long", "short")], (3, 5, 7, 9, 15, 17, 19, 21), strict=True)]


def combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of codes for each customer: every code takes every value, in many combinations."""
    k = F.col("c_custkey")
    code = lambda m, a: F.when((k * m + a) % 7 != 6, (F.floor(k / m) + k + a) % 5 - 2).cast("double")
    ratio = lambda m, d: F.when((k * m) % 11 != 10, ((k * m) % 31) / F.lit(d)).cast("double")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("symbol"), *[code(m, a).alias(c) for c, m, a in CODES], *[ratio(m, d).alias(c) for c, m, d in RATIOS])


COMBO_SQL = "combo AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, " + ", ".join(
    [f"CASE WHEN (c_custkey * {m} + {a}) % 7 <> 6 THEN CAST((c_custkey // {m} + c_custkey + {a}) % 5 - 2 AS DOUBLE) END AS {c}" for c, m, a in CODES]
    + [f"CASE WHEN (c_custkey * {m}) % 11 <> 10 THEN ((c_custkey * {m}) % 31) / {d} END AS {c}" for c, m, d in RATIOS]
) + " FROM customer)"

"""Window primitives over bars: every frame shares one partitioning and order.

Expressions of one dependency level in one select become one Window node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol"]


def by_time():
    return Window.partitionBy(*KEY).orderBy("ts")


def whole():
    return Window.partitionBy(*KEY)


def last_n(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(c: Column | str, n: int, value: Column) -> Column:
    """``value`` where the last n bars all have ``c``."""
    return F.when(F.count(col(c)).over(last_n(n)) == n, value)


def sma(c, n: int) -> Column:
    return full(c, n, F.avg(col(c)).over(last_n(n)))


def rsum(c, n: int) -> Column:
    return full(c, n, F.sum(col(c)).over(last_n(n)))


def sma_adaptive(c, length: int, floor: int = 4) -> Column:
    """Mean of up to ``length`` bars, from max(floor, half of min(length, bars of the symbol)) on."""
    bars = F.count(F.lit(1)).over(whole())
    least = F.greatest(F.lit(floor), F.floor(F.least(F.lit(length), bars) / 2))
    return F.when((F.count(col(c)).over(last_n(length)) >= least) & (bars >= floor), F.avg(col(c)).over(last_n(length)))


def rmax(c, n: int) -> Column:
    return full(c, n, F.max(col(c)).over(last_n(n)))


def rmin(c, n: int) -> Column:
    return full(c, n, F.min(col(c)).over(last_n(n)))


def donchian(n: int) -> Column:
    return (rmax("high", n) + rmin("low", n)) / 2


def stddev(c, n: int, ddof: int = 0) -> Column:
    return full(c, n, (F.stddev_pop if ddof == 0 else F.stddev_samp)(col(c)).over(last_n(n)))


def bollinger(c, n: int, k: float = 2.0, ddof: int = 0) -> tuple[Column, Column]:
    mid, s = sma(c, n), stddev(c, n, ddof)
    return mid - k * s, mid + k * s


def ols_slope(c, n: int, index="rn") -> Column:
    """Least-squares slope; ``index`` is the bar number within the symbol."""
    return full(c, n, F.regr_slope(col(c), col(index)).over(last_n(n)))


def linreg(c, n: int, index="rn") -> Column:
    """Value of the least-squares line at the last bar."""
    y, x = col(c), col(index)
    return full(c, n, F.regr_intercept(y, x).over(last_n(n)) + F.regr_slope(y, x).over(last_n(n)) * x)


def pctrank(c, n: int) -> Column:
    """Percentage of the last n values that are no greater than this one."""
    c = col(c)
    return full(c, n, F.size(F.filter(F.collect_list(c).over(last_n(n)), lambda v: v <= c)) * F.lit(100.0) / n)


def vwma(n: int) -> Column:
    return F.try_divide(rsum(F.col("volume") * F.col("close"), n), rsum("volume", n))


def lag(c, k: int = 1) -> Column:
    return F.lag(col(c), k).over(by_time()) if k else col(c)


def diff(c) -> Column:
    return col(c) - lag(c)


def up(c) -> Column:
    d = diff(c)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


def down(c) -> Column:
    d = diff(c)
    return F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))


def slope_n(c, n: int) -> Column:
    return (col(c) - lag(c, n)) / n


def ffill(c) -> Column:
    return F.last(col(c), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def true_range() -> Column:
    """Greatest of the three ranges; the first bar has high - low only."""
    prior = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(by_time()))


def latest(df: DataFrame) -> DataFrame:
    """Last bar of each symbol."""
    return df.withColumn("_r", F.row_number().over(whole().orderBy(F.desc("ts")))).filter("_r = 1").drop("_r")


def tail_bars(df: DataFrame, n: int) -> DataFrame:
    """Last n bars of each symbol."""
    return df.withColumn("_r", F.row_number().over(whole().orderBy(F.desc("ts")))).filter(F.col("_r") <= n).drop("_r")

from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidebar.operators import repair
from tidebar.operators.registry import Instance, apply_profile
from tidebar.operators.resample import resample_4h, resample_monthly, resample_session_daily, resample_weekly
from tidebar.operators.rollup import rollup
from tidebar.plans import fixtures as fx
from tidebar.plans import loading, pipelines

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"


def rows(df):
    return sorted(map(tuple, df.select("symbol", "ts", "open", "high", "low", "close", "adj_close", "volume").collect()))


def test_rollup_is_fold_after_fold(spark, sf_dir):
    """States made in one pass from the finest bars are those of folds of folds."""
    hourly = fx.hourly(spark, sf_dir)
    days = resample_session_daily(hourly)
    out = pipelines.rolled_bars({"intraday_1h": hourly}, "futures", ["intraday_4h", "daily", "weekly", "monthly"])
    for tf, want in (("intraday_4h", resample_4h(hourly)), ("daily", days), ("weekly", resample_weekly(days)), ("monthly", resample_monthly(days))):
        assert rows(out.filter(F.col("timeframe") == tf)) == rows(want)


def test_rollup_scans_and_exchanges_once(spark, sf_dir):
    hourly = spark.createDataFrame(fx.hourly(spark, sf_dir).toPandas(), BARS)
    made = [pipelines.CALENDARS["futures", tf]["intraday_1h"] for tf in ("intraday_4h", "daily", "weekly")]
    plan = rollup(hourly, made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        rollup(hourly, [])


def test_rollup_of_nulls(spark):
    """A bucket without volume has none; a first bar without an open gives none; nothing from no bars."""
    t = lambda h: datetime(2024, 1, 2, h)
    bars = spark.createDataFrame([("a", t(1), None, 3.0, 1.0, 2.0, None, None), ("a", t(2), 5.0, 6.0, 4.0, None, None, None), ("b", t(17), 1.0, 1.0, 1.0, 1.0, 9.0, 2.0)], BARS)
    out = {(r["timeframe"], r["symbol"]): r for r in pipelines.rolled_bars({"intraday_1h": bars}, "futures", ["intraday_4h", "daily"]).collect()}
    a = out["intraday_4h", "a"]
    assert (a["open"], a["high"], a["low"], a["close"], a["adj_close"], a["volume"]) == (None, 6.0, 1.0, None, None, None)
    assert ("daily", "b") not in out and out["intraday_4h", "b"]["adj_close"] == 9.0  # the 17:00 hour is maintenance
    assert pipelines.rolled_bars({"intraday_1h": bars.limit(0)}, "futures", ["daily"]).count() == 0


def test_cascade_reads_its_base_once_and_has_benchmarks(spark, sf_dir):
    daily = fx.daily(spark, sf_dir)
    two = tuple(r["symbol"] for r in daily.select("symbol").distinct().orderBy("symbol").limit(2).collect())
    made = pipelines.cascade({"daily": daily}, "stocks", "daily", benchmarks=two)
    for tf in ("weekly", "monthly"):
        plan = made[tf]._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan
        assert pipelines.snapshot(made[tf], "stocks", tf).count() == 5
        assert made[tf].filter("spy_qqq_vol_ma_ratio is not null").count() > 0
    same = pipelines.cascade({"daily": daily}, "stocks", "daily", benchmarks={"weekly": pipelines.bars_of({"daily": daily}, "stocks", "weekly").filter(F.col("symbol").isin(*two))})
    ratio = lambda df: sorted((r["symbol"], r["ts"], r["spy_qqq_vol_ma_ratio"]) for r in df.collect())
    assert ratio(same["weekly"]) == ratio(made["weekly"])
    assert {r["spy_qqq_vol_ma_ratio"] for r in same["daily"].collect()} == {None}
    made.release()
    same.release()


def test_load_steps_by_hand(spark):
    """A bad hour is mended, the grid filled, the forming bar made of repaired fine bars, other symbols carried or left."""
    now = datetime(2024, 1, 18, 15, 40)  # a Thursday
    t = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    bar = lambda s, at, o, h, low, c, v: (s, at, o, h, low, c, c, v)
    hourly = [bar("a", t(18, 5, 3), 10.0, 10.1, 9.9, 10.0, 5.0), bar("a", t(18, 5, 40), 10.0, 10.2, 10.0, 10.1, 2.0), bar("a", t(18, 6), 10.0, 99.0, 10.0, 10.0, 7.0), bar("b", t(18, 5), 20.0, 20.0, 20.0, 20.0, 1.0), bar("c", t(18, 9), 30.0, 30.0, 30.0, 30.0, 1.0)]
    fine = [bar("a", t(18, 15, 5), 11.0, 11.1, 11.0, 11.05, 3.0), bar("a", t(18, 15, 10), -1.0, 11.1, 11.0, 11.0, 3.0), bar("b", t(18, 9, 5), 21.0, 21.0, 21.0, 21.0, 1.0)]
    hourly, fine = spark.createDataFrame(hourly, BARS), spark.createDataFrame(fine, BARS)
    watch = {"hourly": Observation("hourly"), "recent": Observation("recent")}
    got = {(r["symbol"], r["ts"].hour): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in loading.stocks_4h(hourly, fine, now, watch=watch).collect()}
    assert got == {
        ("a", 5): (10.0, 10.2, 9.9, 10.1, 7.0),
        ("a", 9): (10.1, 10.1, 10.1, 10.1, 0.0),
        ("a", 13): (11.0, 11.1, 11.0, 11.05, 3.0),
        ("b", 5): (20.0, 20.0, 20.0, 20.0, 1.0),
        ("b", 9): (20.0, 20.0, 20.0, 20.0, 0.0),
        ("b", 13): (20.0, 20.0, 20.0, 20.0, 0.0),
        ("c", 9): (30.0, 30.0, 30.0, 30.0, 1.0),
    }
    assert watch["hourly"].get == {"bars_total": 4, "bars_repaired": 1}
    closed = loading.futures_4h(hourly, fine, datetime(2024, 1, 20, 15, 40))  # a Saturday
    assert rows(closed) == rows(resample_4h(hourly))
    opened = {(r["symbol"], r["ts"].hour): r["close"] for r in loading.futures_4h(hourly, fine, now).collect()}
    assert opened == {("a", 5): 10.0, ("a", 13): 11.0, ("b", 5): 20.0, ("b", 13): 20.0, ("c", 9): 30.0}
    with pytest.raises(ValueError):
        loading.futures_eod(hourly, hourly, "yearly", 5)


def test_observed_repairs_are_those_of_the_telemetry(spark, sf_dir):
    bars = fx.hourly(spark, sf_dir)
    watch = Observation("all")
    out = repair.repair_ticks(bars, 20.0, watch)
    counts = repair.repair_telemetry(repair.repair_ticks(bars, 20.0), "x").collect()
    out.write.format("noop").mode("overwrite").save()
    assert watch.get["bars_total"] == bars.count()
    assert watch.get["bars_repaired"] == sum(r["bars_repaired"] for r in counts) > 0


def test_bars_keep_columns_of_their_own(spark, sf_dir):
    """Columns that begin like those that indicators use inside stay."""
    bars = fx.hourly(spark, sf_dir).withColumn("_x", F.lit(1))
    out = apply_profile(bars, [Instance("e", "exh_abs_price_action", {"lookback": 20, "z": 1}), Instance("w", "wyckoff_stage", {"fast": 3, "inter": 4, "slow": 5})])
    assert out.filter("_x = 1 and w is not null and e is not null").count() > 0

import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import frames, repair
from tidebar.operators.kernel import Series, recursions
from tidebar.operators.registry import Instance, apply_profile, validate

T0 = datetime(2024, 1, 2)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"


def bars(spark, closes, volumes=None, symbol="a", width=1.0):
    rows = [(symbol, T0 + timedelta(hours=i), c, None if c is None else c + width, None if c is None else c - width, c, c, float(v)) for i, (c, v) in enumerate(zip(closes, volumes or [1] * len(closes), strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [None if r[name] is None or (isinstance(r[name], float) and math.isnan(r[name])) else r[name] for r in df.orderBy("ts").collect()]


def test_ema_gap(spark):
    df = bars(spark, [None, 1.0, 2.0, None, 4.0])
    out = recursions(df, [Series("e1", "ema", "close", 3)])
    assert column(out, "e1") == [None, None, None, None, pytest.approx(3.1666666667)]
    assert out.filter(F.isnan("e1")).count() == 0  # missing is NULL, never NaN


def test_recursions_over_small_batches(spark):
    """Batches of seven bars against the whole series at once, with gaps that span batches."""
    import random

    rng = random.Random(3)
    closes = [None if rng.random() < 0.3 or 40 < i < 60 else rng.uniform(1, 9) for i in range(150)]
    df = bars(spark, closes).unionByName(bars(spark, [None, None, 4.0, *closes[:90]], symbol="b")).repartition(3)
    wanted = [Series("e", "ema", "close", 9), Series("w", "wilder", "close", 5), Series("v", "vma", "close", 5, by="volume"), Series("m", "macdv", "e", by="w", over="open"), Series("ms", "ema", "m", 4)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = recursions(df.withColumn("volume", F.lit(0.25)), wanted).toPandas().sort_values(["symbol", "ts"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == 243
    for _, part in out.groupby("symbol"):
        x = part["close"].astype("float64").reset_index(drop=True)
        e, w = (x.ewm(alpha=a, adjust=False, min_periods=n).mean() for a, n in ((0.2, 9), (0.2, 5)))
        m = (e - w) / part["open"].astype("float64").reset_index(drop=True) * 100
        for name, want in (("e", e), ("w", w), ("m", m), ("ms", m.ewm(alpha=0.4, adjust=False, min_periods=4).mean())):
            pd.testing.assert_series_equal(part[name].astype("float64").reset_index(drop=True), want, check_names=False)
        prev, vma = None, []
        for v in x:
            prev = prev if math.isnan(v) else v if prev is None else 0.25 * v + 0.75 * prev
            vma.append(math.nan if math.isnan(v) else prev)
        pd.testing.assert_series_equal(part["v"].astype("float64").reset_index(drop=True), pd.Series(vma), check_names=False)


@pytest.mark.parametrize("stretch", ["1 hour", "10 hours", "37 hours", "5000 hours"])
def test_recursions_from_stretches(spark, stretch):
    """Any cut of a symbol into stretches gives the rows of one walk: gaps across and around stretches, late starts, no values, no time order in the input."""
    import random

    rng = random.Random(5)
    closes = [None if rng.random() < 0.3 or 40 < i < 75 else rng.uniform(1, 9) for i in range(150)]
    df = bars(spark, closes).unionByName(bars(spark, [None] * 23 + [4.0, *closes[:90]], symbol="b")).unionByName(bars(spark, [None] * 30, symbol="c")).repartition(5)
    df = df.withColumns({"volume": F.when(F.hour("ts") % 5 != 0, F.hour("ts") / 30), "dense": (F.hour("ts") * 7 % 11).cast("double")})
    wanted = [Series("e", "ema", "close", 9), Series("w", "wilder", "close", 5), Series("v", "vma", "close", 5, by="volume"), Series("m", "macdv", "e", by="w", over="open"), Series("ms", "ema", "m", 4), Series("mm", "wilder", "ms", 3), Series("r", "pctrank", "close", 4), Series("rr", "pctrank", "dense", 60)]
    one, many = (x.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (recursions(df, wanted), recursions(df, wanted, stretch=stretch)))
    assert list(one.columns) == list(many.columns) and one["mm"].notna().sum() > 100
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-12)


def test_stretches_spread_one_symbol(spark):
    """One symbol reaches several tasks, and batches of three bars change nothing."""
    df = bars(spark, [float(k % 7) for k in range(400)])
    wanted = [Series("e", "ema", "close", 5)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = recursions(df, wanted, stretch="20 hours")
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        small = out.orderBy("ts").toPandas()["e"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    pd.testing.assert_series_equal(small, recursions(df, wanted).orderBy("ts").toPandas()["e"])


def test_percent_rank_is_that_of_the_window(spark):
    """Ties, gaps, a frame longer than the series, batches of five: as over the window."""
    import random

    rng = random.Random(9)
    df = bars(spark, [None if rng.random() < 0.1 else float(rng.randrange(6)) for _ in range(90)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        for n in (1, 2, 7, 100):
            out = recursions(df, [Series("r", "pctrank", "close", n)]).withColumn("w", frames.pctrank("close", n)).orderBy("ts").collect()
            assert [r["r"] for r in out] == [r["w"] for r in out]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_composition_of_summaries():
    """Summaries join in any grouping, and stand for the walk over their bars."""
    import numpy as np

    from tidebar.operators.kernel import Recursion

    rng = np.random.default_rng(2)
    for r in (Recursion(0.3, 4), Recursion(1.0, 1), Recursion()):
        x, w = rng.uniform(1, 5, 60), rng.uniform(0, 1, 60)
        x[rng.random(60) < 0.4] = np.nan
        x[:5] = np.nan
        cuts = [0, 3, 4, 11, 30, 31, 60]
        parts = [r.summary(x[a:b], w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        left = parts[0]
        for p in parts[1:]:
            left = r.joined(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = r.joined(p, right)
        assert left == pytest.approx(right, rel=1e-12) and left == pytest.approx(r.summary(x, w), rel=1e-12)
        assert r.after(r.START, left) == pytest.approx(r(r.START, x, w)[1], rel=1e-12)


def test_recursions_reuse_the_partitioning_of_windows(spark):
    df = bars(spark, [1.0, 2.0]).repartition("symbol").withColumn("s", frames.sma("close", 2))
    plan = recursions(df, [Series("e", "ema", "close", 2)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_windows_need_all_values(spark):
    df = bars(spark, [1.0, None, 3.0, 4.0, 5.0])
    assert column(df.withColumn("v", frames.sma("close", 3)), "v") == [None, None, None, None, 4.0]


def test_first_true_range(spark):
    df = bars(spark, [10.0, 20.0])
    assert column(df.withColumn("v", frames.true_range()), "v") == [2.0, 11.0]


def test_vma_all_equal_prices(spark):
    df = bars(spark, [5.0] * 40)
    out = apply_profile(df, [Instance("w", "wyckoff_stage", {"fast": 3, "inter": 4, "slow": 5})])
    assert set(column(out, "w")) == {0.0}


def test_short_history_is_null_for_whole_symbol(spark):
    out = apply_profile(bars(spark, [1.0, 2.0, 3.0]), [Instance("w", "wyckoff_stage", {"fast": 3, "inter": 4, "slow": 5}), Instance("q", "ttm_squeeze_pro", {}), Instance("m", "movingavg_trend_bullish", {"length": 10})])
    assert column(out, "w") == [None] * 3 and column(out, "q") == [None] * 3 and column(out, "m") == [0.0] * 3


def test_zero_volume_vwma(spark):
    df = bars(spark, [1.0, 2.0, 3.0], volumes=[0, 0, 0])
    assert column(df.withColumn("v", frames.vwma(2)), "v") == [None, None, None]


def test_zero_atr_macdv(spark):
    out = apply_profile(bars(spark, [5.0] * 60, width=0.0), [Instance("g", "macdv_guard", {})])
    assert set(column(out, "g")) == {0.0}


def test_registry_rejects(spark):
    with pytest.raises(ValueError, match="unknown indicator"):
        validate([Instance("x", "nope")])
    with pytest.raises(ValueError, match="missing"):
        validate([Instance("x", "wyckoff_stage", {"fast": 3})])


def test_missing_columns_pass_through(spark):
    df = spark.createDataFrame([("a", 1)], "symbol string, x int")
    assert apply_profile(df, [Instance("w", "macdv_guard", {})]).columns == df.columns


def test_order_and_partitions_do_not_matter(spark):
    df = bars(spark, [float(i % 7 + i / 3) for i in range(80)], volumes=[i % 5 + 1 for i in range(80)])
    wanted = [Instance("w", "wyckoff_stage", {"fast": 3, "inter": 5, "slow": 8}), Instance("e", "exh_abs_price_action", {"lookback": 10}), Instance("q", "ttm_squeeze_pro", {"length": 10})]
    one = apply_profile(df, wanted).orderBy("ts").toPandas()
    two = apply_profile(df.orderBy(F.rand(3)).repartition(7), wanted).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_repair(spark):
    df = bars(spark, [-1.0, 10.0, 0.0, 12.0])
    out = repair.repair_ticks(df, 0.5)
    assert column(out, "close") == [-1.0, 10.0, 10.0, 12.0] and column(out, "repaired") == [False, False, True, False] and column(out, "volume")[2] == 0.0


def test_repair_telemetry_counts_bad_bars(spark):
    both = bars(spark, [-1.0, 10.0, 0.0, 12.0]).unionByName(bars(spark, [5.0, 6.0], symbol="b"))
    assert [tuple(r) for r in repair.repair_telemetry(repair.repair_ticks(both, 0.5), "x").collect()] == [("a", 4, 2, "x")]


def test_grid_fills_holes_and_drops_halves(spark):
    at = datetime(2024, 1, 2, 1)
    rows = [(0, 1.0, 2.0, 0.5, 1.5, None, 3.0), (2, None, 9.0, 8.0, 8.5, None, 4.0), (4, None, None, None, None, 7.0, 5.0), (5, 1.0, 2.0, 1.0, 2.0, 2.5, None)]
    df = spark.createDataFrame([("a", at + timedelta(hours=4 * k), *r) for k, *r in rows], SCHEMA)
    out = {(r["ts"] - at).seconds // 14400: tuple(r)[2:] for r in repair.fill_grid(df).collect()}
    # the half bar at 2 goes, but its close is carried into 3 and 4
    assert out == {0: (1.0, 2.0, 0.5, 1.5, None, 3.0), 1: (1.5,) * 5 + (0.0,), 3: (8.5,) * 5 + (0.0,), 4: (8.5,) * 5 + (0.0,), 5: (1.0, 2.0, 1.0, 2.0, 2.5, 0.0)}


def test_an_indicator_that_cannot_be_planned_is_null(spark):
    wanted = [Instance("bad", "significant_volume", {"lookback": "no number"}), Instance("worse", "wyckoff_stage", {"fast": None, "inter": 2, "slow": 3}), Instance("good", "macdv_guard", {})]
    out = apply_profile(bars(spark, [5.0] * 10), wanted)
    assert set(column(out, "bad")) == set(column(out, "worse")) == {None} and set(column(out, "good")) == {0.0}


def test_upsert_is_idempotent(spark):
    old, new = bars(spark, [1.0, 2.0, 3.0]), bars(spark, [1.0, 9.0])
    once = repair.upsert_window(new, old, 3)
    assert column(once, "close") == [1.0, 9.0, 3.0]
    assert column(repair.upsert_window(new, once, 3), "close") == [1.0, 9.0, 3.0]
    assert column(repair.upsert_window(new, old, 2), "close") == [9.0, 3.0]


def test_partial_bar(spark):
    now = T0 + timedelta(hours=3, minutes=20)
    old = bars(spark, [1.0, 2.0, 3.0])
    early = spark.createDataFrame([("a", now - timedelta(hours=2), 5.0, 5.0, 5.0, 5.5, 5.5, 1.0)], SCHEMA)
    assert column(repair.patch_partial(old, old.limit(0), now), "close") == [1.0, 2.0, 3.0]  # no ticks at all: as it was
    assert column(repair.patch_partial(old, early, now), "close") == [1.0, 2.0, 3.0, 3.0]
    assert column(repair.patch_partial(bars(spark, [1.0, 2.0, None]), early, now), "close") == [1.0, 2.0, None, 2.0]  # the last close there is
    assert column(repair.patch_partial(old.limit(0), early, now), "close") == [5.5]
    assert column(repair.patch_partial(old, old.limit(0), now, stub="null"), "close") == [1.0, 2.0, 3.0, None]
    assert column(repair.patch_partial(old, early, now, gate=F.lit(False)), "close") == [1.0, 2.0, 3.0]
    tick = spark.createDataFrame([("a", now, 7.0, 8.0, 6.0, 7.5, 7.5, 4.0)], SCHEMA)
    assert column(repair.patch_partial(old, tick, now), "close") == [1.0, 2.0, 3.0, 7.5]


def test_quarters_with_spine(spark):
    from tidebar.operators.resample import resample_quarterly

    rows = [("a", datetime(2024, m, 3), 1.0, 2.0, 0.5, 1.5, None, 3.0) for m in (1, 8)]
    out = resample_quarterly(spark.createDataFrame(rows, SCHEMA), emit_empty=True).orderBy("ts").collect()
    assert [r["volume"] for r in out] == [3.0, 0.0, 3.0] and out[1]["close"] is None and out[0]["adj_close"] == 1.5

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidebar.plans import config, fixtures, pipelines
from tidebar.sources import bars as src


def test_bars_round_trip_and_partition_overwrite(spark, sf_dir, tmp_path):
    h = fixtures.hourly(spark, sf_dir).withColumns({"namespace": F.lit("futures"), "timeframe": F.lit("intraday_1h")})
    path = str(tmp_path / "bars")
    src.write_bars(h, path)
    src.write_bars(h.limit(10).withColumn("timeframe", F.lit("daily")), path)
    back = src.read_bars(spark, path, "futures", "intraday_1h")
    assert back.count() == h.count() and src.read_bars(spark, path, "futures", "daily").count() == 10
    one = src.read_bars(spark, path, "futures", "intraday_1h", symbols=["click"], since=datetime(2024, 1, 20))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan and "PushedFilters: [" in plan and "click" in plan


def test_combo_history(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "symbol string, x double")
    for day in (1, 2, 3):
        src.write_combo(df.withColumn("x", F.lit(float(day))), str(tmp_path), "stocks", "c", datetime(2024, 1, day))
    assert src.read_combo_asof(spark, str(tmp_path), "stocks", "c").first()["x"] == 3.0
    assert src.read_combo_asof(spark, str(tmp_path), "stocks", "c", "2024-01-02T23-00-00").first()["x"] == 2.0


def test_lists(spark, tmp_path):
    (tmp_path / "shortlist_stocks.csv").write_text("Ticker,name\n aapl ,x\n,y\n")
    assert [r["symbol"] for r in src.read_universe(spark, str(tmp_path), "shortlist_stocks").collect()] == ["AAPL"]
    assert src.read_universe(spark, str(tmp_path), "other").count() == 0
    (tmp_path / "l.txt").write_text("Symbol|Name\nA|x\nB|y\nFile Creation Time: 0101|\n")
    assert sorted(r["symbol"] for r in src.read_listing(spark, str(tmp_path / "l.txt")).collect()) == ["A", "B"]
    (tmp_path / "o.csv").write_text("symbol,etf_symbol_primary,etf_symbol_secondary,notes\na,xlk,nan,n1\na,xlf,,n2\nb,,xlk,\n")
    assert [tuple(r) for r in src.read_overrides(spark, str(tmp_path / "o.csv")).collect()] == [("A", "XLF", None, "n2")]


def test_conform(spark):
    df = spark.createDataFrame([("A", datetime(2024, 1, 1), "1.5", 9)], "Symbol string, Date timestamp_ntz, Close string, junk int")
    r = src.conform_bars(df).first()
    assert (r["symbol"], r["close"], r["open"]) == ("A", 1.5, None) and len(r) == 8


def test_pipeline_from_bars_to_scored_combo(spark, sf_dir):
    h = fixtures.hourly(spark, sf_dir)
    steps = pipelines.cascade({"intraday_1h": h}, "futures", "intraday_1h", 150)
    assert list(steps) == ["intraday_1h", "intraday_4h", "daily"]
    snaps = {tf: pipelines.snapshot(df, "futures", tf) for tf, df in steps.items()}
    cfg = config.Combo("c", "futures", "intraday_1h", "intraday_4h", "daily", "shortlist_futures")
    out = pipelines.run_combo(snaps, cfg, spark.createDataFrame([("click",), ("view",)], "symbol string"))
    rows = out.select("symbol", "signal", "mtf_long_score").collect()
    assert {r["symbol"] for r in rows} <= {"click", "view"} and rows and all(r["signal"] in ("long", "short", "none") for r in rows)
    with pytest.raises(ValueError, match="lacks"):
        src.snapshot_columns(h, ["nope"])


def test_universe_health_alerts_and_stored_scores(spark, tmp_path):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "symbol string")
    meta = spark.createDataFrame([("A", True, 2e9), ("B", True, 5e8), ("C", False, 3e9), ("D", True, None), ("E", True, 9e9)], "symbol string, has_options boolean, market_cap double")
    meta = meta.withColumns({"name": F.lit("n"), "sector": F.lit("Energy"), "industry": F.lit("Oil"), "sub_industry": F.lit(None).cast("string")})
    funds = spark.createDataFrame([("XLE", "Energy Select", 0)], "symbol string, name string, pos int")
    chosen, fund_map = pipelines.build_universe([one("A", "B", "C"), one("A", "D", "E")], one("E"), meta, funds)
    assert [r["symbol"] for r in chosen.collect()] == ["A"] and fund_map.first()["etf_symbol_primary"] == "XLE"

    scored = spark.createDataFrame([("a", "long"), ("b", "short")], "symbol string, signal string")
    state = spark.createDataFrame([], "alert_key string, fingerprint string, saved_at string")
    digest, row = pipelines.run_alerts(scored, "k", state, "1")
    assert digest.count() == 2
    assert pipelines.run_alerts(scored, "k", state.unionByName(row), "2")[0].count() == 0

    health = [tuple(r) for r in pipelines.run_health({"x": (scored, one("A", "B", "Z"))}).collect()]
    assert health == [("x", "coverage", False, 1), ("x", "nonempty", True, 2)]

    made = []
    make = lambda: made.append(1) or scored
    for _ in range(2):
        assert pipelines.etf_scores(spark, str(tmp_path), "daily", make).count() == 2
    assert made == [1, 1]  # made, not stored
    pipelines.store_etf_trends(scored, str(tmp_path), "daily")
    assert pipelines.etf_scores(spark, str(tmp_path), "daily", make).count() == 2 and made == [1, 1]


def test_cascade_table_and_folds(spark, sf_dir):
    assert config.CASCADE["stocks", "intraday_130m"] == ["daily", "weekly"] and ("futures", "weekly") not in config.CASCADE
    d = fixtures.daily(spark, sf_dir)
    month = {(r["symbol"], r["ts"]): r["volume"] for r in pipelines.bars_of({"daily": d}, "stocks", "monthly").collect()}
    days = {}
    for r in d.collect():
        days.setdefault((r["symbol"], r["ts"].year, r["ts"].month), []).append((r["ts"], r["volume"]))
    assert month == {(k[0], min(v)[0]): sum(x for _, x in v) for k, v in days.items()}
    with pytest.raises(ValueError, match="no bars"):
        pipelines.bars_of({"daily": d}, "stocks", "intraday_9h")


def test_lookbacks():
    at = datetime(2024, 3, 1, 13, 5)
    assert src.lookback_start("daily", 3, at) == datetime(2024, 2, 26) and src.lookback_start("weekly", 2, at) == datetime(2024, 2, 16)
    assert src.lookback_start("monthly", 2, at) == src.lookback_start("yearly", 9, at) and src.lookback_start("intraday_1h", 5, at) == datetime(2024, 2, 25)


def test_configuration(tmp_path):
    params = {"stocks": {"daily": {"w": {"id": "wyckoff_stage", "fast_len": 2, "int_len": 3, "slow_len": 4, "vma_length_source": "fast"}, "g": {"id": "macdv_guard", "z": 0}}}}
    combos = {"stocks": {"a": {"universe": "u", "lower_tf": "daily", "lower_profile": "p"}, "b": {"universe": "t", "upper_tf": "daily", "upper_profile": "q"}}}
    c = config.resolve({"p": ["w"], "q": ["w", "g"]}, params, combos)
    assert [i.key for i in c.profile("stocks", "daily")] == ["w", "g"] and c.profile("stocks", "daily")[0].params == {"fast": 2, "inter": 3, "slow": 4}
    assert c.universes("stocks", "daily") == ["t", "u"] and c.universes("stocks", "weekly") == [] and c.profile("futures", "daily") == []
    for bad, message in [
        (({}, params, combos), "unknown profile"),
        (({"p": ["w"], "q": []}, {}, combos), "no parameters for stocks/daily"),
        (({"p": ["x"], "q": []}, params, combos), "no parameters for stocks/daily/x"),
        (({"p": ["w"], "q": []}, {"stocks": {"daily": {"w": {"id": "nope"}}}}, combos), "unknown indicator"),
        (({"p": ["w"], "q": []}, {"stocks": {"daily": {"w": {"z": 1}}}}, combos), "no id"),
        (({"p": ["w"], "q": []}, {"stocks": {"daily": {"w": {"id": "macdv_guard", "zz": 1}}}}, combos), "no such parameter"),
    ]:
        with pytest.raises(ValueError, match=message):
            config.resolve(*bad)
    import json

    for name, value in (("indicator_profiles", {"profiles": {"p": ["w"], "q": ["g"]}}), ("indicator_params", {"indicators": params}), ("multi_timeframe_combos", combos), ("timeframes", {"stocks": {"daily": {"window_bars": 9}}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert config.load(str(tmp_path)).windows == {("stocks", "daily"): 9}


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from tidebar.sources.scratch import shared_dir

    spark = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert shared_dir(spark("yarn", "hdfs:///x")) == "hdfs:///x"
    assert shared_dir(spark("local[4]", None)).startswith("file:///")
    for master in ("yarn", "local-cluster[2,1,512]", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(spark(master, None))


def test_universe_filters_bars_before_the_exchange(spark, tmp_path):
    """A bloom filter of the universe drops other symbols' bars where they are scanned; rows are those of a plain restriction."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    bars = spark.range(4000).select(F.lit("n").alias("namespace"), F.lit("1h").alias("timeframe"), F.concat(F.lit("s"), F.col("id") % 400).alias("symbol"), (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") / 400).cast("int"))).alias("ts"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")])
    src.write_bars(bars, str(tmp_path / "bars"))
    spark.range(40).select(F.concat(F.lit("s"), F.col("id")).alias("symbol"), (F.col("id") % 4).alias("kind")).write.parquet(str(tmp_path / "universe"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        universe = spark.read.parquet(str(tmp_path / "universe")).filter("kind = 1")
        out = src.read_bars(spark, str(tmp_path / "bars"), "n", "1h", since=t0 + timedelta(hours=2), universe=universe)
        got = sorted((r["symbol"], r["ts"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan
    assert len(got) == 10 * 8 and {s for s, _ in got} == {f"s{k}" for k in range(40) if k % 4 == 1}
    assert src.read_bars(spark, str(tmp_path / "bars"), "n", "1h", universe=universe.limit(0)).count() == 0

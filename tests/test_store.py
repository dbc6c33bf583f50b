import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebar.operators.resample import BAR
from tidebar.sources.store import BarStore

KIND = "namespace string, timeframe string, symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"


def bars(spark, symbols, hours, price, timeframe="1h"):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([("n", timeframe, s, t0 + timedelta(hours=h), price, price, price, price, price, 1.0) for s in symbols for h in hours], KIND)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def held(df):
    out = {}
    for r in df.orderBy("symbol", "ts").collect():
        out.setdefault(r["symbol"], []).append((r["ts"].hour, r["close"]))
    return out


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "t"), 16)
    assert store.read("n", "1h").count() == 0
    symbols = [f"s{k}" for k in range(40)]
    assert store.upsert(bars(spark, symbols, range(4), 1.0), 3) == 1
    assert store.upsert(bars(spark, ["s1"], range(4), 7.0, "4h"), 3) == 2
    before = files(store.path)
    assert store.upsert(bars(spark, ["s3", "new"], [3, 4], 2.0), 3) == 3
    after = files(store.path)
    assert {f: after[f] for f in before} == before and 1 <= len(after) - len(before) <= 2
    got = held(store.read("n", "1h"))
    assert got.pop("s3") == [(2, 1.0), (3, 2.0), (4, 2.0)] and got.pop("new") == [(3, 2.0), (4, 2.0)]
    assert set(map(tuple, got.values())) == {((1, 1.0), (2, 1.0), (3, 1.0))} and len(got) == 39
    assert held(store.read("n", "4h")) == {"s1": [(1, 7.0), (2, 7.0), (3, 7.0)]}
    assert held(store.read("n", "1h", version=1))["s3"] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    few = store.read("n", "1h", symbols=["s3"])
    assert len(few.inputFiles()) == 1 and set(held(few)) == {"s3"}
    rows = store.read("n", "1h").count()
    assert store.vacuum() >= 1 and store.read("n", "1h").count() == rows and len(files(store.path)) < len(after)
    assert store.upsert(bars(spark, [], [], 1.0), 3) == 3


def test_failed_upsert_leaves_the_old_state(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "t"), 4)
    store.upsert(bars(spark, ["a", "b"], range(3), 1.0), 9)
    want = held(store.read("n", "1h"))
    bad = bars(spark, ["a"], range(3), 5.0).withColumn("close", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad, 9)
    assert held(store.read("n", "1h")) == want
    assert store.upsert(bars(spark, ["a"], [0], 5.0), 9) == 2
    assert held(store.read("n", "1h"))["a"][0] == (0, 5.0)


def test_one_of_two_upserts_commits(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "t"), 4)
    store.upsert(bars(spark, ["a"], range(3), 1.0), 9)
    version, folders = store.manifest()
    store.upsert(bars(spark, ["a"], range(3), 2.0), 9)
    with pytest.raises(RuntimeError, match="taken"):
        store._commit(version + 1, folders)
    assert held(store.read("n", "1h"))["a"][0] == (0, 2.0)
    store._fs.createNewFile(store._at(f"{store.path}/versions/{9:010d}.lock"))
    with pytest.raises(RuntimeError, match="under way"):
        store.upsert(bars(spark, ["a"], range(3), 3.0), 9)
    store.unlock()
    assert store.upsert(bars(spark, ["a"], range(3), 3.0), 9) == 3
    with pytest.raises(ValueError, match="buckets"):
        BarStore(spark, store.path, 5).manifest()


def test_columns_and_ties(spark, tmp_path):
    """Other columns are left out; of new bars of one time the greatest stays; NULL symbols have a bucket too."""
    store = BarStore(spark, str(tmp_path / "t"), 4)
    store.upsert(bars(spark, ["a", None], [1], 1.0).unionByName(bars(spark, ["a"], [1], 2.0)).withColumn("bucket", F.lit("z")), 9)
    out = store.read("n", "1h")
    assert out.columns == ["namespace", "timeframe", *BAR]
    assert sorted((r["symbol"] or "", r["close"]) for r in out.collect()) == [("", 1.0), ("a", 2.0)]

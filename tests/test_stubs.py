from datetime import datetime, timedelta

import pytest

from tidebar.streaming.forming import forming_bars_with_stubs, into_table, newest

TICKS = "symbol string, ts timestamp, price double, id long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(h, m=0):
    return datetime(2024, 1, 4, h, m)


def play(spark, path, batches, **kw):
    """Bars after each batch, as {(symbol, hour): (open, high, low, close, volume)}."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(f"{path}/in/part={k}")
        stream = spark.readStream.schema(TICKS).parquet(f"{path}/in/part=*")
        q = into_table(forming_bars_with_stubs(stream, **kw), f"{path}/bars", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append({(r["symbol"], (r["ts"] - at(0)) / timedelta(hours=1)): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in newest(spark, f"{path}/bars").collect()})
    return out


def test_silent_symbol_gets_stubs(rocks, tmp_path):
    """b falls silent while a ticks: its hours are carried forward, and a late tick makes its bar and the stubs after it again."""
    one, two, three = play(
        rocks,
        str(tmp_path),
        [
            [("a", at(10, 5), 1.0, 1), ("a", at(10, 50), 3.0, 2), ("b", at(10, 10), 20.0, 3), ("b", at(10, 20), 19.0, 4)],
            [("a", at(13, 30), 5.0, 5), (None, at(13, 31), 5.0, 6), ("b", None, 5.0, 7)],
            [("b", at(13, 25), 30.0, 8), ("a", at(13, 31), 4.0, 9), ("a", at(14, 5), 6.0, 10)],
        ],
    )
    assert one == {("a", 10): (1.0, 3.0, 1.0, 3.0, 2.0), ("b", 10): (20.0, 20.0, 19.0, 19.0, 2.0)}
    stub = lambda x: (x, x, x, x, 0.0)
    assert two == one | {("a", 11): stub(3.0), ("a", 12): stub(3.0), ("a", 13): (5.0, 5.0, 5.0, 5.0, 1.0), **{("b", h): stub(19.0) for h in (11, 12, 13)}}
    assert three == two | {("a", 13): (5.0, 5.0, 4.0, 4.0, 2.0), ("a", 14): (6.0, 6.0, 6.0, 6.0, 1.0), ("b", 13): (30.0, 30.0, 30.0, 30.0, 1.0)} | ({("b", 14): stub(30.0)} if ("b", 14) in three else {})


def test_gate_and_four_hours(rocks, tmp_path):
    """No stub where the gate is closed, though closes are carried over it; four-hour buckets start at 1, 5, 9, 13, 17, 21."""
    (out,) = play(rocks, str(tmp_path), [[("a", at(2), 1.0, 1), ("b", at(14), 2.0, 2), ("b", at(22), 3.0, 3)]], hours=4, gate=lambda t: t.hour != 9)
    assert {k: v[3:] for k, v in out.items()} == {("a", 1): (1.0, 1.0), ("a", 5): (1.0, 0.0), ("a", 13): (1.0, 0.0), ("a", 17): (1.0, 0.0), ("a", 21): (1.0, 0.0), ("b", 13): (2.0, 1.0), ("b", 17): (2.0, 0.0), ("b", 21): (3.0, 1.0)}


def test_ticks_out_of_order(rocks, tmp_path):
    """A tick of an hour before the first one seen, which the watermark leaves open, makes its bar."""
    _, two = play(rocks, str(tmp_path), [[("a", at(10, 5), 2.0, 1)], [("a", at(9, 58), 1.0, 2)]])
    assert two == {("a", 9): (1.0, 1.0, 1.0, 1.0, 1.0), ("a", 10): (2.0, 2.0, 2.0, 2.0, 1.0)}

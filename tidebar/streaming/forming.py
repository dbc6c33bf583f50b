"""Forming bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.resample import BAR


def forming_bars(ticks: DataFrame, hours: int = 1, lateness: str = "10 minutes") -> DataFrame:
    """Bars of one or four hours (anchored at 17:00) from a stream of (symbol, ts, price, id).

    Late ticks within the watermark emit their bar again, in update mode.
    """
    start = "1 hour" if hours == 4 else "0 hours"
    at = F.struct("ts", "id")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", f"{hours} hours", startTime=start).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")
    )


def into_table(bars: DataFrame, path: str, checkpoint: str):
    """A query whose every batch is one immutable folder; ``newest`` reads the last state of each bar.

    A batch that is retried overwrites its own folder, so the sink is idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def newest(spark, path: str) -> DataFrame:
    """The newest emission of each (symbol, ts)."""
    df = spark.read.parquet(path)
    return df.groupBy("symbol", "ts").agg(F.max_by(F.struct(*[c for c in BAR if c not in ("symbol", "ts")]), "batch").alias("b")).select("symbol", "ts", "b.*").select(*BAR)


class Former(StatefulProcessor):
    """The bars of one symbol that ticks can still change, and the last close before them.

    Every bucket from the first tick on has a bar as soon as the stream's
    watermark has reached its start: of its ticks, or a stub that carries the
    last close with volume 0.  A timer at the start of the next bucket makes
    stubs when no tick comes.  A late tick makes its bar again, and the stubs
    after it.
    """

    def __init__(self, hours: int, gate: Callable[[datetime], bool] | None):
        self.width, self.gate = hours * 3600, gate
        self.shift = 3600 if hours == 4 else 0  # the ladder 17, 21, 1, 5, 9, 13

    def init(self, handle) -> None:
        self.handle = handle
        # start: open, high, low, close, volume, first tick, last tick; NULL ticks for a stub
        self.bars = handle.getMapState("bars", "start long", "open double, high double, low double, close double, volume double, first_ts long, first_id long, last_ts long, last_id long")

    def bucket(self, seconds: int) -> int:
        return (seconds - self.shift) // self.width * self.width + self.shift

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars, mark = self._held(), timerValues.getCurrentWatermarkInMs() // 1000
        changed = set()
        for pdf in rows:
            times = pdf["ts"].astype("datetime64[us]").astype("int64")
            for at, price, number in sorted(zip(times.tolist(), pdf["price"].tolist(), pdf["id"].tolist(), strict=True)):
                start = self.bucket(at // 1_000_000)
                if start + self.width <= mark:
                    continue  # can no longer change
                changed.add(start)
                old = bars.get(start)
                tick = (at, number)
                if old is None or old[5] is None:
                    bars[start] = (price, price, price, price, 1.0, *tick, *tick)
                else:
                    first, last = tick < old[5:7], tick > old[7:9]
                    bars[start] = (price if first else old[0], max(old[1], price), min(old[2], price), price if last else old[3], old[4] + 1, *(tick if first else old[5:7]), *(tick if last else old[7:9]))
        yield from self._settled(key, bars, changed, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, self._held(), set(), timerValues)

    def _held(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.bars.iterator()}

    def _settled(self, key, bars: dict[int, tuple], changed: set[int], timers) -> Iterator[pd.DataFrame]:
        """Make and remake stubs, emit what has changed, let go of what is final, set the next timer."""
        if not bars:
            return
        mark = timers.getCurrentWatermarkInMs() // 1000
        top = max(max(bars), self.bucket(mark) if mark > 0 else 0)
        close = None
        for start in range(min(bars), top + self.width, self.width):
            bar = bars.get(start)
            if bar is None and (self.gate is None or self.gate(_moment(start))) or bar is not None and bar[5] is None and close is not None and bar[3] != close:
                bars[start] = bar = (close, close, close, close, 0.0, None, None, None, None)
                changed.add(start)
            close = bar[3] if bar is not None else close
        final = [s for s in sorted(bars) if s + self.width <= mark and s < max(bars)][:-1]  # one stays, for its close
        for start in final:
            self.bars.removeKey((start,))
        for start in changed.difference(final):
            self.bars.updateValue((start,), bars[start])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((top + self.width) * 1000)
        if changed:
            rows = [(key[0], _moment(s), *bars[s][:4], bars[s][3], bars[s][4]) for s in sorted(changed)]
            yield pd.DataFrame(rows, columns=BAR)

    def close(self) -> None:
        pass


def _moment(seconds: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(seconds=seconds)


def forming_bars_with_stubs(ticks: DataFrame, hours: int = 1, lateness: str = "10 minutes", gate: Callable[[datetime], bool] | None = None) -> DataFrame:
    """As ``forming_bars``, and carry-forward bars for symbols that fall silent.

    State is kept by symbol: the bars that the watermark leaves open and one
    before them.  ``gate``: whether a bucket that starts at a moment may have a
    stub.  Ticks without symbol, time, price or id are left out.  Needs the
    RocksDB state store.
    """
    known = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price"), F.col("id").cast("long").alias("id")).dropna()
    made = known.withWatermark("ts", lateness).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Former(hours, gate), outputStructType="symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double", outputMode="Update", timeMode="EventTime"
    )
    return made.select(*BAR)

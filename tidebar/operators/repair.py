"""Series repair and merge: bad ticks, gaps, forming bars, upserts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.nulls import yes
from ..functions.session import is_extended_4h_bucket
from .frames import ffill, tail_bars
from .resample import BAR, fold_bars

PRICES = ["open", "high", "low", "close"]


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Unreadable prices become NULL, a NULL volume 0."""
    out = df.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in [*PRICES, "adj_close"] if c in df.columns})
    return out.withColumn("volume", F.coalesce(F.nanvl(F.col("volume").try_cast("double"), F.lit(None).cast("double")), F.lit(0.0)))


def is_bad(max_range: float) -> Column:
    o, h, low, c = (F.col(x) for x in PRICES)
    missing = o.isNull() | h.isNull() | low.isNull() | c.isNull()
    return missing | yes((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0)) | yes(h < low) | yes(F.try_divide(h - low, F.abs(c)) > max_range)


def repair_ticks(df: DataFrame, max_range: float = 0.08, watch: Observation | None = None) -> DataFrame:
    """Bad bars take the last good close and volume 0; with no good bar before, they stay. Adds ``bad`` and ``repaired``.

    ``watch`` is filled with ``bars_total`` and ``bars_repaired`` by the job that
    uses the bars, without another pass (once, if the plan has several).
    """
    good = coerce_numeric(df).withColumn("bad", is_bad(max_range)).withColumn("_good", F.when(~F.col("bad"), F.col("close"))).withColumn("_last", ffill("_good"))
    mend = F.col("bad") & F.col("_last").isNotNull()
    out = good.withColumn("repaired", mend)
    out = out.withColumns({c: F.when(mend, F.col("_last")).otherwise(F.col(c)) for c in [*PRICES, "adj_close"]} | {"volume": F.when(mend, F.lit(0.0)).otherwise(F.col("volume"))})
    out = out.drop("_good", "_last")
    return out if watch is None else out.observe(watch, F.count(F.lit(1)).alias("bars_total"), F.count_if("bad").alias("bars_repaired"))


def repair_telemetry(repaired: DataFrame, source: str) -> DataFrame:
    """Bars and bad bars, mended or not, of the symbols that have bad ones."""
    counts = repaired.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars_total"), F.sum(F.col("bad").cast("int")).alias("bars_repaired"))
    return counts.filter("bars_repaired > 0").withColumn("source", F.lit(source))


def fill_grid(df: DataFrame, step: str = "4 HOURS", valid=is_extended_4h_bucket) -> DataFrame:
    """Bars on every calendar point of the grid.

    Points without any price carry the last close, of whatever bar, and have no
    volume; bars that lack some prices only, and points before the first close,
    are dropped.
    """
    ends = df.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = ends.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("ts")).filter(valid(F.col("ts")))
    out = grid.join(df, ["symbol", "ts"], "left").withColumn("_c", ffill("close")).withColumn("_empty", F.coalesce(*PRICES).isNull())
    out = out.withColumns({c: F.when(F.col("_empty"), F.col("_c")).otherwise(F.col(c)) for c in [*PRICES, "adj_close"]} | {"volume": F.when(F.col("_empty"), F.lit(0.0)).otherwise(F.coalesce("volume", F.lit(0.0)))})
    return valid_ohlc(out).select(*BAR)


def valid_ohlc(df: DataFrame) -> DataFrame:
    return df.dropna(how="any", subset=PRICES)


def dedupe_last(df: DataFrame, order: str) -> DataFrame:
    """For each (symbol, ts) the row that comes last by ``order``."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert_window(new: DataFrame, old: DataFrame, n: int) -> DataFrame:
    """Union of both, new bars win, last n of each symbol stay."""
    both = new.select(*BAR, F.lit(1).alias("_p")).unionByName(old.select(*BAR, F.lit(0).alias("_p")))
    return tail_bars(dedupe_last(both, "_p").drop("_p"), n)


def stitch(derived: DataFrame, vendor: DataFrame, n: int) -> DataFrame:
    """Top symbols with fewer than n derived bars off with vendor bars; derived bars win."""
    short = derived.groupBy("symbol").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= n).select("symbol")
    return upsert_window(derived, vendor.join(short, "symbol", "left_anti"), n)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and ``second`` for the symbols that it lacks."""
    return first.unionByName(second.join(first.select("symbol").distinct(), "symbol", "left_anti"))


def bucket_start(now: datetime, hours: int) -> datetime:
    """Start of the hour, or of the 4-hour bucket anchored at 17:00, that holds ``now``."""
    hour = now.replace(minute=0, second=0, microsecond=0)
    return hour - timedelta(hours=(hour.hour - 1) % hours if hours > 1 else 0)


def patch_partial(bars: DataFrame, ticks: DataFrame, now: datetime, hours: int = 1, gate: Column | None = None, stub: str = "carry") -> DataFrame:
    """Bring the forming bar of each symbol up to date.

    Ticks (fine bars) of the current bucket make the bar and overwrite it; else
    an existing bar stays; else a stub carries the last close there is, of the
    bars or else of ticks before the bucket.  Symbols without any tick stay as
    they are, and so does everything where ``gate`` (which may use symbol and
    ts, the start of the bucket) is not true.

    With ``stub="null"`` there are no ticks to look at: every symbol that has
    bars but none in the current bucket gets a bar of NULLs.
    """
    start = F.lit(bucket_start(now, hours)).cast("timestamp_ntz")
    end = start + F.expr(f"INTERVAL {hours} HOURS")
    none = F.lit(None).cast("double")
    if stub == "null":
        extra = bars.select("symbol").distinct().select("symbol", start.alias("ts"), *[none.alias(x) for x in BAR[2:]], F.lit(0).alias("_p"))
    else:
        made = fold_bars(ticks.filter((F.col("ts") >= start) & (F.col("ts") < end)), start).select(*BAR, F.lit(2).alias("_p"))
        closes = bars.select("symbol", "close", F.struct(F.lit(1).alias("own"), "ts").alias("at"), F.lit(False).alias("tick"))
        early = F.when(F.col("ts") < start, F.col("close"))
        closes = closes.unionByName(ticks.select("symbol", early.alias("close"), F.struct(F.lit(0).alias("own"), "ts").alias("at"), F.lit(True).alias("tick")))
        last = closes.groupBy("symbol").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("at"))).alias("c"), F.bool_or("tick").alias("t")).filter("t and c is not null")
        extra = made.unionByName(last.select("symbol", start.alias("ts"), *[F.col("c").alias(x) for x in [*PRICES, "adj_close"]], F.lit(0.0).alias("volume"), F.lit(0).alias("_p")))
    extra = extra if gate is None else extra.filter(yes(gate))
    return dedupe_last(bars.select(*BAR, F.lit(1).alias("_p")).unionByName(extra), "_p").drop("_p")

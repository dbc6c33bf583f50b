"""Reading and writing bars, lists, snapshots and combos."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_symbol
from ..operators.asof import asof_join
from ..operators.resample import BAR

SCHEMA = "namespace string, timeframe string, symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"
SYMBOL_NAMES = ["symbol", "Symbol", "ticker", "Ticker"]
#: Calendar days that hold one bar, for look-backs.
DAYS_PER_BAR = {"daily": 1.5, "weekly": 7.0}
LONG_LOOKBACK_DAYS = 19_000


def read_bars(spark: SparkSession, path: str, namespace: str, timeframe: str, symbols: list[str] | None = None, since: datetime | None = None, window: int | None = None, asof: datetime | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Bars of one namespace and timeframe; both prune partitions, the rest reaches the Parquet scan.

    ``universe``: a table of symbols too many to list.  They are joined as they
    are, so that Spark can broadcast a small one, and where bars must be shuffled
    build a bloom filter of a filtered one (``spark.sql.optimizer.runtime.bloomFilter``)
    and drop other bars where they are scanned, before the exchange.  No job
    runs for it beforehand, and an empty one leaves no bars.

    With ``window`` only what must be read to hold so many bars up to ``asof`` (now, if not given).
    """
    if window is not None:
        start = lookback_start(timeframe, window, asof or datetime.now(timezone.utc).replace(tzinfo=None))
        since = start if since is None else max(since, start)
    df = spark.read.schema(SCHEMA).parquet(path).filter((F.col("namespace") == namespace) & (F.col("timeframe") == timeframe))
    df = df.filter(F.col("symbol").isin(symbols)) if symbols else df
    df = df.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else df
    return df if universe is None else df.join(universe.select("symbol"), "symbol", "left_semi").select(df.columns)


def write_bars(df: DataFrame, path: str) -> None:
    """Replaces the (namespace, timeframe) partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "timeframe").parquet(path)


write_snapshot = write_bars


def read_snapshot(spark: SparkSession, path: str, namespace: str, timeframe: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("namespace") == namespace) & (F.col("timeframe") == timeframe))


def write_combo(df: DataFrame, path: str, namespace: str, combo: str, asof: datetime | None = None) -> str:
    """The current combo, and a dated copy of it in the history; returns the date's key (UTC).

    ``df`` is made once, for the history, of which the current combo is a copy.
    Where it has no rows, what the two tables hold stays.
    """
    key = (asof or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H-%M-%S")
    keys = {k: F.lit(v) for k, v in (("namespace", namespace), ("combo", combo), ("asof", key))}  # as literals they need no sort before they partition
    dated, made = df.withColumns(keys), Observation()
    dated.observe(made, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/history")
    written = df.sparkSession.read.schema(dated.schema).parquet(f"{path}/history")
    copy = reduce(DataFrame.filter, [F.col(k) == v for k, v in keys.items()], written).withColumns(keys) if made.get["n"] else dated.limit(0)
    copy.drop("asof").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "combo").parquet(f"{path}/current")
    return key


def _history(spark: SparkSession, path: str) -> DataFrame:
    # dates such as 2024-01-02T03-04-05 must stay strings
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/history").withColumn("asof", F.col("asof").cast("string"))


def read_combo_asof(spark: SparkSession, path: str, namespace: str, combo: str, asof: str | None = None) -> DataFrame:
    """The latest history of a combo, or the latest no later than ``asof``; found by the job that reads it."""
    history = _history(spark, path).filter((F.col("namespace") == namespace) & (F.col("combo") == combo))
    history = history.filter(F.col("asof") <= asof) if asof else history
    return history.filter(F.col("asof") == history.agg(F.max("asof")).scalar())


def combo_history_at(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The history that each request (namespace, combo, asof, and any other columns) would have seen, for all of them at once.

    ``asof`` is the request's moment, ``seen_asof`` the date of what it saw;
    requests before the first date, and of unknown combos, give no rows.
    """
    history = _history(spark, path)
    dates = history.select("namespace", "combo", "asof").distinct()
    seen = asof_join(requests, dates, ["namespace", "combo"], "asof", prefix="seen_").filter("seen_asof is not null")
    rows = history.withColumnRenamed("asof", "seen_asof")
    return seen.join(rows, ["namespace", "combo", "seen_asof"])


def symbol_dim(df: DataFrame) -> DataFrame:
    """The first symbol column there is, trimmed and in capitals."""
    name = next((c for c in SYMBOL_NAMES if c in df.columns), None)
    if name is None:
        raise ValueError(f"no symbol column among {df.columns}")
    return df.select(norm_symbol(F.col(name).cast("string")).alias("symbol"), *[c for c in df.columns if c != name]).filter("symbol <> ''")


def read_universe(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named list; an unknown name is an empty one."""
    if name not in ("shortlist_stocks", "shortlist_futures", "options_eligible"):
        return spark.createDataFrame([], "symbol string")
    return symbol_dim(spark.read.csv(f"{folder}/{name}.csv", header=True))


def read_etfs(spark: SparkSession, path: str) -> DataFrame:
    """ETFs in the order of their file: symbol as it stands, name, pos; the first row of a symbol holds."""
    df = spark.read.csv(path, header=True)
    name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    rows = df.filter("symbol is not null").select("symbol", F.struct(F.monotonically_increasing_id().alias("pos"), name.alias("name")).alias("r"))
    return rows.groupBy("symbol").agg(F.min("r").alias("r")).select("symbol", "r.name", "r.pos")


def read_listing(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """A pipe-delimited exchange listing without its footer."""
    df = spark.read.csv(path, header=True, sep="|")
    return df.filter(~F.coalesce(F.col(df.columns[0]).startswith("File Creation Time"), F.lit(False))).select(F.col(f"`{column}`").alias("symbol")).filter("symbol is not null")


def union_listings(*listings: DataFrame) -> DataFrame:
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out.distinct()


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides with a primary ETF; blanks and "nan" count as absent, the last row of a symbol holds."""
    clean = lambda c: F.nullif(F.nullif(norm_symbol(F.col(c)), F.lit("")), F.lit("NAN"))
    df = spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id())
    df = df.select(clean("symbol").alias("symbol"), clean("etf_symbol_primary").alias("etf_symbol_primary"), clean("etf_symbol_secondary").alias("etf_symbol_secondary"), "notes", "_n").filter("symbol is not null and etf_symbol_primary is not null")
    return df.groupBy("symbol").agg(F.max_by(F.struct("etf_symbol_primary", "etf_symbol_secondary", "notes"), "_n").alias("r")).select("symbol", "r.*")


def conform_bars(df: DataFrame) -> DataFrame:
    """Vendor columns, whatever their case and spaces, as bars; missing ones and what cannot be read are NULL, others go."""
    plain = {c.lower().replace(" ", "_"): c for c in df.columns}
    kinds = {"symbol": "string", "ts": "timestamp_ntz"}
    aliases = {"ts": ("ts", "date", "datetime", "timestamp")}

    def pick(name: str) -> Column:
        found = next((plain[a] for a in aliases.get(name, (name,)) if a in plain), None)
        return (F.col(f"`{found}`") if found else F.lit(None)).try_cast(kinds.get(name, "double")).alias(name)

    return df.select(*[pick(c) for c in BAR])


def drop_legacy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("(")])


def lookback_start(timeframe: str, bars: int, asof: datetime) -> datetime:
    """The first moment of the day from which bars must be read to hold so many of them."""
    days = LONG_LOOKBACK_DAYS if timeframe in ("monthly", "quarterly", "yearly") else int(bars * DAYS_PER_BAR.get(timeframe, 1.0))
    return datetime(asof.year, asof.month, asof.day) - timedelta(days=days)


def snapshot_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Base columns and configured keys, an error if one is missing."""
    if missing := [c for c in [*BAR, *keys] if c not in df.columns]:
        raise ValueError(f"snapshot lacks {', '.join(missing)}")
    return df.select(*BAR, *keys)

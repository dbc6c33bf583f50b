"""Registered queries over sources, sinks and lists: written to the shared folder and read back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import session as ss
from ..functions import text as tx
from ..operators import combos, desk, frames, repair, resample
from ..operators.asof import asof_join
from ..sources import bars as src
from ..sources.scratch import shared_dir
from ..sources.store import BarStore
from . import fixtures as fx
from . import oracle as o
from . import pipelines
from .queries import _FUTURES, _MATCH, BARS, _funds, _scored, _stocks, query, r6


def fresh(s) -> str:
    return f"{shared_dir(s)}/tidebar-{uuid.uuid4().hex}"


def _tagged(df: DataFrame, namespace: str, timeframe: str) -> DataFrame:
    return df.withColumns({"namespace": F.lit(namespace), "timeframe": F.lit(timeframe)})


@query("bars_round_trip", o.sql(f"SELECT {BARS} FROM h1 UNION ALL SELECT {BARS} FROM d1", "h1", "d1"))
def bars_round_trip(s, d):
    """Two partitions written, one of them twice, and both read."""
    path = fresh(s)
    src.write_bars(_tagged(fx.daily(s, d).limit(10), "stocks", "daily"), path)
    src.write_bars(_tagged(fx.hourly(s, d), "futures", "intraday_1h"), path)
    src.write_bars(_tagged(fx.daily(s, d), "stocks", "daily"), path)
    return src.read_bars(s, path, "futures", "intraday_1h").unionByName(src.read_bars(s, path, "stocks", "daily")).select(*BARS.split(", "))


_STORED = "SELECT symbol, ts, open, high, low, close + {k} AS close, adj_close, volume FROM h1 WHERE {where}"
_LOADS = ["ts < TIMESTAMP '2024-01-15'", "ts >= TIMESTAMP '2024-01-10' AND symbol < 'm'", "ts >= TIMESTAMP '2024-01-20' AND symbol >= 'm'"]


@query(
    "bar_store",
    o.sql(
        f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS q FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY k DESC) AS r FROM ({' UNION ALL '.join(f'SELECT *, {k} AS k FROM ({_STORED.format(k=k, where=w)})' for k, w in enumerate(_LOADS))})) WHERE r = 1) WHERE q <= 300",
        "h1",
    ),
)
def bar_store(s, d):
    """Three upserts into a bucketed table, two of which touch some symbols only."""
    store = BarStore(s, fresh(s), 8)
    for k, where in enumerate(_LOADS):
        store.upsert(_tagged(fx.hourly(s, d).filter(where.replace("TIMESTAMP", "TIMESTAMP_NTZ")).withColumn("close", F.col("close") + k), "futures", "intraday_1h"), 300)
    store.vacuum()
    return store.read("futures", "intraday_1h").select(*BARS.split(", "))


@query("bars_in_lookback", o.sql(f"SELECT {BARS} FROM d1 WHERE ts >= TIMESTAMP '1997-07-01' - INTERVAL 390 DAYS AND symbol IN ('1-URGENT', '2-HIGH', '5-LOW')", "d1"))
def bars_in_lookback(s, d):
    path = fresh(s)
    src.write_bars(_tagged(fx.daily(s, d), "stocks", "daily"), path)
    return src.read_bars(s, path, "stocks", "daily", symbols=["1-URGENT", "2-HIGH", "5-LOW"], window=260, asof=datetime(1997, 7, 1, 15)).select(*BARS.split(", "))


@query("bars_of_universe", o.sql(f"SELECT {BARS} FROM h1 WHERE symbol IN (SELECT event_type FROM events WHERE value > (SELECT quantile_cont(value, 0.9999) FROM events))", "h1"))
def bars_of_universe(s, d):
    """Only the symbols that had one of the greatest values."""
    path = fresh(s)
    src.write_bars(_tagged(fx.hourly(s, d), "futures", "intraday_1h"), path)
    events = fx.table(s, d, "events")
    top = events.filter(F.col("value") > events.agg(F.percentile("value", 0.9999)).scalar()).select(F.col("event_type").alias("symbol"))
    return src.read_bars(s, path, "futures", "intraday_1h", universe=top).select(*BARS.split(", "))


@query("snapshot_round_trip", o.sql(f"SELECT {BARS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM h1) WHERE r = 1", "h1"))
def snapshot_round_trip(s, d):
    path = fresh(s)
    src.write_snapshot(_tagged(frames.latest(fx.hourly(s, d)), "futures", "intraday_1h"), path)
    return src.read_snapshot(s, path, "futures", "intraday_1h").select(*BARS.split(", "))


_DAYS = [datetime(2024, 1, k, 12) for k in (1, 2, 3)]


@query("combo_history", o.sql("SELECT symbol, macdv_guard + 2 AS x, '2024-01-02T12-00-00' AS asof FROM combo UNION ALL SELECT symbol, macdv_guard + 3, '2024-01-03T12-00-00' FROM combo", "combo"))
def combo_history(s, d):
    """Three dates of one combo: the last one no later than a moment, and the last one there is."""
    path = fresh(s)
    for k, day in enumerate(_DAYS, 1):
        src.write_combo(fx.combo(s, d).select("symbol", (F.col("macdv_guard") + k).alias("x")), path, "stocks", "c", day)
    return src.read_combo_asof(s, path, "stocks", "c", "2024-01-02T18-00-00").unionByName(src.read_combo_asof(s, path, "stocks", "c")).select("symbol", "x", "asof")


_AT = "TIMESTAMP '2024-01-02 00:00:00' + INTERVAL (c_custkey % 60) HOURS"


@query(
    "combo_history_at",
    o.sql(f"SELECT r.custkey, r.asof, strftime(h.day, '%Y-%m-%dT%H-%M-%S') AS seen_asof, c.symbol, c.macdv_guard + h.k AS x FROM (SELECT c_custkey AS custkey, strftime({_AT}, '%Y-%m-%dT%H-%M-%S') AS asof, {_AT} AS moment FROM customer) r ASOF JOIN (VALUES {', '.join(f"(TIMESTAMP '{day}', {k})" for k, day in enumerate(_DAYS, 1))}) h(day, k) ON r.moment >= h.day JOIN combo c ON c.symbol = CAST(r.custkey AS VARCHAR)", "combo"),
)
def combo_history_at(s, d):
    """Each customer asks for its combo at a moment of its own."""
    path = fresh(s)
    for k, day in enumerate(_DAYS, 1):
        src.write_combo(fx.combo(s, d).select("symbol", (F.col("macdv_guard") + k).alias("x")), path, "stocks", "c", day)
    moment = F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 60).cast("int"))
    asked = fx.table(s, d, "customer").select(F.lit("stocks").alias("namespace"), F.lit("c").alias("combo"), F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss").alias("asof"), F.col("c_custkey").alias("custkey"))
    return src.combo_history_at(s, path, asked).filter(F.col("symbol") == F.col("custkey").cast("string")).select("custkey", "asof", "seen_asof", "symbol", "x")


_ASOF = o.sql("SELECT e.event_id, e.event_type AS symbol, e.ts, b.ts AS bar_ts, b.close AS bar_close FROM (SELECT event_id, event_type, ts FROM events) e ASOF LEFT JOIN m15 b ON b.symbol = e.event_type AND e.ts >= b.ts + INTERVAL 15 MINUTES", "m15")


def _asof(stretch: str | None):
    def run(s, d):
        """The last quarter hour that was over when a tick came."""
        bars = fx.minutes(s, d, 15).select("symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("at"), "ts", "close")
        ticks = fx.table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("ts").cast("timestamp_ntz").alias("at"))
        return asof_join(ticks, bars, ["symbol"], "at", stretch, "bar_").select("event_id", "symbol", "ts", "bar_ts", "bar_close")

    return run


query("asof_bars", _ASOF)(_asof(None))
query("asof_bars_stretched", _ASOF)(_asof("6 hours"))


def _csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


@query("universe_list", o.sql("SELECT upper(trim(c_name)) AS symbol, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'"))
def universe_list(s, d):
    """A list whose column is called Ticker, with blanks around names and some blank ones; an unknown list is empty."""
    path = fresh(s)
    blank = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")))
    _csv(fx.table(s, d, "customer").select(blank.alias("Ticker"), F.col("c_mktsegment").alias("segment")), f"{path}/options_eligible.csv")
    return src.read_universe(s, path, "options_eligible").unionByName(src.read_universe(s, path, "unknown"), allowMissingColumns=True)


@query("listing_union", o.sql("SELECT c_name AS symbol FROM customer UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer"))
def listing_union(s, d):
    """Pipe-delimited listings with a footer, of which two share names."""
    a, b, c = fresh(s), fresh(s), fresh(s)
    names = fx.table(s, d, "customer").select(F.col("c_name").alias("Symbol"), F.col("c_mktsegment").alias("Security Name"))
    foot = names.limit(1).select(F.lit("File Creation Time: 0101").alias("Symbol"), F.lit(None).cast("string").alias("Security Name"))
    _csv(names.unionByName(foot), a, "|")
    _csv(fx.table(s, d, "supplier").select(F.col("s_name").alias("ACT Symbol"), F.col("s_nationkey").alias("n")), b, "|")
    _csv(names, c, "|")
    return src.union_listings(src.read_listing(s, a), src.read_listing(s, b, "ACT Symbol"), src.read_listing(s, c))


@query("etf_list", o.sql("SELECT symbol, name, row_number() OVER (ORDER BY k) AS place FROM (SELECT p_brand AS symbol, first(p_name ORDER BY p_partkey) AS name, min(p_partkey) AS k FROM part GROUP BY p_brand)"))
def etf_list(s, d):
    """One file in the order of its rows; the first row of a symbol holds."""
    path = fresh(s)
    _csv(fx.table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), "p_partkey").repartition(1).sortWithinPartitions("p_partkey"), path)
    return src.read_etfs(s, path).select("symbol", "name", F.row_number().over(Window.orderBy("pos")).alias("place"))  # a list of ETFs is small


_OVERRIDDEN = """ov AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, 'X' || p_size AS op, CASE WHEN p_size % 2 = 0 THEN 'Y' || p_size END AS os, p_type AS notes FROM part WHERE p_size >= 20),
 eo AS (SELECT em.* EXCLUDE (etf_symbol_primary, etf_symbol_secondary, etf_match_source), coalesce(op, etf_symbol_primary) AS etf_symbol_primary, CASE WHEN op IS NOT NULL THEN os ELSE etf_symbol_secondary END AS etf_symbol_secondary,
   CASE WHEN op IS NOT NULL THEN 'override' ELSE 'fuzzy' END AS etf_match_source, notes AS etf_override_notes FROM em LEFT JOIN ov USING (symbol))"""


@query("etf_match_overrides", o.sql("SELECT * EXCLUDE (industry_score, sector_score), round(industry_score, 6) AS industry_score, round(sector_score, 6) AS sector_score FROM eo", extra=f"{_MATCH}, {_OVERRIDDEN}"))
def etf_match_overrides(s, d):
    """Overrides read from a file in which "nan" and blanks mean absent, and rows without a primary do not count."""
    path = fresh(s)
    size = F.col("p_size")
    primary = F.when(size < 10, " nan ").when(size < 20, "").otherwise(F.concat(F.lit(" x"), size.cast("string")))
    secondary = F.when(size % 2 == 0, F.concat(F.lit("y"), size.cast("string"))).otherwise("NaN")
    _csv(fx.table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" ")).alias("symbol"), primary.alias("etf_symbol_primary"), secondary.alias("etf_symbol_secondary"), F.col("p_type").alias("notes")), path)
    return r6(combos.match_by_tokens(_stocks(s, d), _funds(s, d), src.read_overrides(s, path)), "industry_score", "sector_score")


@query("vendor_bars", o.sql("SELECT symbol, ts, CASE WHEN open > 3 THEN round(open, 2) END AS open, high, low, close, CAST(NULL AS DOUBLE) AS adj_close, CASE WHEN volume > 2 THEN volume ELSE 0.0 END AS volume FROM h1", "h1"))
def vendor_bars(s, d):
    """Vendor columns of other case, as text that is not always a number, with a pivot's leftovers and no adjusted close."""
    h = fx.hourly(s, d)
    vendor = h.select(
        F.col("symbol").alias("Symbol"), F.col("ts").alias("DateTime"), F.when(F.col("open") > 3, F.round("open", 2).cast("string")).otherwise("n/a").alias("OPEN"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
        F.when(F.col("volume") > 2, F.col("volume").cast("string")).alias("Volume"), F.lit(1).alias("Dividends"), F.lit(2).alias("('open', 'a')"),
    )
    return repair.coerce_numeric(src.conform_bars(src.drop_legacy(vendor)))


@query(
    "new_york_time",
    o.sql("SELECT event_id, CASE WHEN t >= TIMESTAMP '2024-03-10 07:00:00' AND t < TIMESTAMP '2024-11-03 06:00:00' THEN t - INTERVAL 4 HOURS ELSE t - INTERVAL 5 HOURS END AS ny FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + to_months(CAST(event_id % 12 AS INTEGER)) AS t FROM events)"),
)
def new_york_time(s, d):
    """Times of all months of 2024 from UTC to New York's wall clock."""
    e = fx.table(s, d, "events")
    return e.select("event_id", ss.to_new_york(F.col("ts").cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 12).cast("int")), "UTC").alias("ny"))


@query("text_functions", o.sql("""SELECT p_partkey, replace(replace(p_type || '/' || p_name, ' ', '_'), '/', '_') AS key,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity
 FROM (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: p_size > 5)) AS a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+')) AS b FROM part)"""))
def text_functions(s, d):
    p = fx.table(s, d, "part")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    a = F.when(F.col("p_size") > 5, words(F.col("p_name"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", tx.safe_key(F.concat_ws("/", "p_type", "p_name")).alias("key"), F.round(tx.jaccard(a, words(F.concat_ws(" ", "p_type", "p_name"))), 6).alias("similarity"))


query("bars_floor_1h", o.sql(o.fold("m15", "date_trunc('hour', ts)"), "m15"))(lambda s, d: resample.floor_1h(fx.minutes(s, d, 15)))
query("archived_sort", o.sql("SELECT symbol, l AS mtf_long_score, s AS mtf_short_score FROM fb ORDER BY l DESC, s DESC, symbol LIMIT 100", "combo", extra=_FUTURES))(
    lambda s, d: desk.sort_archived(_scored(s, d).select("symbol", "mtf_long_score", "mtf_short_score")).limit(100)
)
query("view_groups", o.sql("SELECT symbol, lower_ttm_squeeze_pro, lower_macdv_core_bull, macdv_guard FROM combo", "combo"))(
    lambda s, d: desk.select_groups(fx.combo(s, d).select("symbol", "lower_ttm_squeeze_pro", "middle_wyckoff_stage", "lower_macdv_core_bull", "upper_wyckoff_stage", "macdv_guard"), {"middle", "upper"})
)
query(
    "universe_restrict",
    o.sql("SELECT 'listed' AS kind, symbol, macdv_guard FROM combo WHERE symbol IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders) UNION ALL SELECT 'all', symbol, macdv_guard FROM combo", "combo"),
)(
    lambda s, d: combos.restrict(c := fx.combo(s, d).select("symbol", "macdv_guard"), u := fx.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"))).withColumn("kind", F.lit("listed")).unionByName(combos.restrict(c, u.limit(0)).withColumn("kind", F.lit("all")))
)


def _segment(s, d, *names: str) -> DataFrame:
    return fx.table(s, d, "customer").filter(F.col("c_mktsegment").isin(*names)).select(F.concat(F.lit(" "), F.lower("c_name")).alias("symbol"))


_LISTS = {"shortlist_stocks": ("BUILDING", "FURNITURE"), "options_eligible": ("FURNITURE", "MACHINERY", "HOUSEHOLD"), "shortlist_futures": ("AUTOMOBILE",)}
_OUT = "c_nationkey < 10"


@query(
    "symbols_for_timeframe",
    o.sql(
        f"""SELECT 'stocks/weekly' AS timeframe, upper(c_name) AS symbol FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND NOT {_OUT}
 UNION ALL SELECT 'stocks/intraday_4h', upper(c_name) FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') UNION ALL SELECT 'futures/daily', upper(c_name) FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
 UNION ALL SELECT 'stocks/monthly', upper(c_name) FROM customer WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY', 'HOUSEHOLD') AND NOT {_OUT}"""
    ),
)
def symbols_for_timeframe(s, d):
    """The universes that the configured combos name for a timeframe; exclusions spare shortlists; one run allows one universe only."""
    out = fx.table(s, d, "customer").filter(_OUT).select(F.col("c_name").alias("symbol"))
    parts = [
        pipelines.symbols_for_timeframe(ns, tf, lambda u: _segment(s, d, *_LISTS[u]), out, allowed).select(F.lit(f"{ns}/{tf}").alias("timeframe"), "symbol")
        for ns, tf, allowed in (("stocks", "weekly", None), ("stocks", "intraday_4h", None), ("futures", "daily", None), ("stocks", "monthly", ["options_eligible"]), ("futures", "yearly", None))
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole

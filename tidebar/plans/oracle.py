"""SQL building blocks of the oracles: the same tables and series as DuckDB CTEs."""

from __future__ import annotations

from .fixtures import COMBO_SQL


def over(n: int, part: str = "symbol") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "OVER (PARTITION BY symbol ORDER BY ts)"


def full(c: str, n: int, e: str) -> str:
    return f"(CASE WHEN count({c}) {over(n)} = {n} THEN {e} END)"


def sma(c: str, n: int) -> str:
    return full(c, n, f"avg({c}) {over(n)}")


def rsum(c: str, n: int) -> str:
    return full(c, n, f"sum({c}) {over(n)}")


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {W}" if k else c


def yes(e: str) -> str:
    return f"coalesce(({e}), FALSE)"


def pctrank(c: str, n: int) -> str:
    return full(c, n, f"len(list_filter(list({c}) {over(n)}, lambda x: x <= {c})) * 100.0 / {n}")


def fold(src: str, bucket: str, where: str = "TRUE", label: str = "b") -> str:
    """Bars from bars; label b (bucket) or t (first bar)."""
    at = "_b" if label == "b" else "min(ts)"
    return (
        f"SELECT symbol, {at} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, "
        f"last(coalesce(adj_close, close) ORDER BY ts) AS adj_close, sum(volume) AS volume FROM (SELECT *, {bucket} AS _b FROM {src} WHERE {where}) GROUP BY symbol, _b"
    )


def fold_ticks(bucket: str, src: str = "ticks") -> str:
    return (
        f"SELECT symbol, {bucket} AS ts, first(price ORDER BY ts, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, id) AS close, "
        f"last(price ORDER BY ts, id) AS adj_close, CAST(count(*) AS DOUBLE) AS volume FROM {src} WHERE price IS NOT NULL GROUP BY symbol, {bucket}"
    )


B4 = "time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2000-01-01 01:00:00')"
MOD = "(hour(ts) * 60 + minute(ts))"
B130 = f"(date_trunc('day', ts)::TIMESTAMP + to_minutes(CAST(570 + 130 * (({MOD} - 570) // 130) AS BIGINT)))"
TRADE_DATE = "(CASE WHEN isodow(ts + INTERVAL 6 HOURS) = 6 THEN date_trunc('day', ts + INTERVAL 6 HOURS)::TIMESTAMP + INTERVAL 2 DAYS ELSE date_trunc('day', ts + INTERVAL 6 HOURS)::TIMESTAMP END)"

CTES = {
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id AS id FROM events)",
    "orders_t": "orders_t AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS price, o_orderkey AS id FROM orders)",
    "h1": f"h1 AS ({fold_ticks("date_trunc('hour', ts)")})",
    "m15": f"m15 AS ({fold_ticks("time_bucket(INTERVAL 15 MINUTES, ts)")})",
    "d1": f"d1 AS ({fold_ticks("date_trunc('day', ts)::TIMESTAMP", 'orders_t')})",
    "combo": COMBO_SQL,
    "d1w": "d1w AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM d1) WHERE r <= 260)",
}

#: Numbered hourly bars with the sources of recursive series.
CTES["nb"] = f"""nb AS (
  SELECT *, greatest(high - low, coalesce(abs(high - c1), high - low), coalesce(abs(low - c1), high - low)) AS tr,
    CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS up, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS down
  FROM (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS bars, lag(close) {W} AS c1 FROM h1))"""


def _weights(n: int) -> str:
    ups, downs = rsum("up", n), rsum("down", n)
    return f"wb AS (SELECT *, coalesce(2.0 / {n + 1} * abs(({ups} - {downs}) / nullif({ups} + {downs}, 0)), 0.0) AS vw FROM nb)"


_EMA = {"e8": ("close", 8), "e10": ("close", 10), "e12": ("close", 12), "e13": ("close", 13), "e15": ("close", 15), "e20": ("close", 20), "e21": ("close", 21), "e26": ("close", 26)}
_WILDER = {"w10": ("close", 10), "w12": ("close", 12), "w13": ("close", 13), "w15": ("close", 15), "w14": ("close", 14), "a14": ("tr", 14), "a20": ("tr", 20), "a26": ("tr", 26), "g14": ("coalesce({}up, 0)", 14), "l14": ("coalesce({}down, 0)", 14)}


def _source(c: str, prefix: str) -> str:
    return c.format(prefix) if "{}" in c else prefix + c


_SEED = ", ".join([f"CAST({_source(c, 'b.')} AS DOUBLE) AS {k}" for k, (c, _) in (_EMA | _WILDER).items()])
_STEP = ", ".join([f"{2 / (n + 1)!r} * {_source(c, 'b.')} + {1 - 2 / (n + 1)!r} * r.{k}" for k, (c, n) in _EMA.items()] + [f"{1 / n!r} * {_source(c, 'b.')} + {1 - 1 / n!r} * r.{k}" for k, (c, n) in _WILDER.items()])
CTES["rec"] = f"""rec AS (
  SELECT b.symbol, b.rn, {_SEED}, CAST(b.close AS DOUBLE) AS vma FROM wb b WHERE b.rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {_STEP}, b.vw * b.close + (1 - b.vw) * r.vma FROM rec r JOIN wb b ON b.symbol = r.symbol AND b.rn = r.rn + 1)"""
_OUT = ", ".join(f"CASE WHEN rn >= {n} THEN {k} END AS {k}" for k, (_, n) in (_EMA | _WILDER).items())
CTES["rs"] = f"rs AS (SELECT wb.*, r.* EXCLUDE (symbol, rn) FROM wb JOIN (SELECT symbol, rn, {_OUT}, vma FROM rec) r USING (symbol, rn))"
CTES["mv0"] = "mv0 AS (SELECT symbol, rn, (e12 - e26) / nullif(a26, 0) * 100 AS m FROM rs WHERE rn >= 26)"
CTES["mrec"] = """mrec AS (
  SELECT symbol, rn, m AS s FROM mv0 WHERE rn = 26
  UNION ALL
  SELECT b.symbol, b.rn, 0.2 * b.m + 0.8 * r.s FROM mrec r JOIN mv0 b ON b.symbol = r.symbol AND b.rn = r.rn + 1)"""
CTES["mv"] = "mv AS (SELECT rs.*, v.m, CASE WHEN x.rn >= 34 THEN x.s END AS s FROM rs LEFT JOIN mv0 v USING (symbol, rn) LEFT JOIN mrec x USING (symbol, rn))"
_DEPENDS = {"h1": ["ticks"], "m15": ["ticks"], "d1": ["orders_t"], "d1w": ["d1"], "nb": ["h1"], "wb": ["nb"], "rec": ["wb"], "rs": ["rec"], "mv0": ["rs"], "mrec": ["mv0"], "mv": ["mrec"]}


def mended(src: str, out: str, limit: float) -> str:
    """CTE ``out``: the bars of ``src`` with bad ones at the last good close."""
    px = ("open", "high", "low", "close", "adj_close")
    bad = yes(f"open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < low OR (high - low) / nullif(abs(close), 0) > {limit}")
    return f"""{out} AS (SELECT symbol, ts, {', '.join(f'CASE WHEN bad AND good IS NOT NULL THEN good ELSE {c} END AS {c}' for c in px)}, CASE WHEN bad AND good IS NOT NULL THEN 0.0 ELSE volume END AS volume
 FROM (SELECT *, last_value(CASE WHEN NOT bad THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS good FROM (SELECT *, {bad} AS bad FROM {src})))"""


def gridded(src: str, out: str) -> str:
    """CTE ``out``: the four-hour bars of ``src`` on every point of the extended calendar."""
    px = ("open", "high", "low", "close", "adj_close")
    return f"""{out}_s AS (SELECT * FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOURS)) AS ts FROM {src} GROUP BY symbol)
   WHERE CASE WHEN isodow(ts) = 6 THEN FALSE WHEN isodow(ts) = 7 THEN hour(ts) IN (17, 21) WHEN isodow(ts) = 5 THEN hour(ts) IN (1, 5, 9, 13, 17) ELSE TRUE END),
 {out}_c AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, coalesce(open, high, low, close) IS NULL AS hole FROM {out}_s LEFT JOIN {src} USING (symbol, ts)),
 {out} AS (SELECT * FROM (SELECT symbol, ts, {', '.join(f'CASE WHEN hole THEN c ELSE {x} END AS {x}' for x in px)}, CASE WHEN hole THEN 0.0 ELSE coalesce(volume, 0.0) END AS volume FROM {out}_c) WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL)"""


def formed(src: str, ticks: str, out: str, start: str, hours: int) -> str:
    """CTE ``out``: the bars of ``src`` with the forming one from ``ticks``, kept, or carried forward."""
    cols = "symbol, ts, open, high, low, close, adj_close, volume"
    now = f"ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{start}' + INTERVAL {hours} HOURS"
    last = "SELECT symbol, last(close ORDER BY ts) AS c FROM {} WHERE close IS NOT NULL{} GROUP BY symbol"
    return f"""{out}_m AS ({fold(ticks, f"TIMESTAMP '{start}'", now)}),
 {out}_l AS (SELECT symbol, coalesce(b.c, t.c) AS c FROM (SELECT DISTINCT symbol FROM {ticks}) LEFT JOIN ({last.format(src, '')}) b USING (symbol) LEFT JOIN ({last.format(ticks, f" AND ts < TIMESTAMP '{start}'")}) t USING (symbol)),
 {out} AS (SELECT {cols} FROM {src} WHERE NOT (ts = TIMESTAMP '{start}' AND symbol IN (SELECT symbol FROM {out}_m)) UNION ALL SELECT {cols} FROM {out}_m
  UNION ALL SELECT symbol, TIMESTAMP '{start}', c, c, c, c, c, 0.0 FROM {out}_l WHERE c IS NOT NULL AND symbol NOT IN (SELECT symbol FROM {out}_m) AND symbol NOT IN (SELECT symbol FROM {src} WHERE ts = TIMESTAMP '{start}'))"""


def sql(body: str, *needs: str, extra: str = "", bars: str = "h1", vma: int = 7, made: str | None = None, of: tuple[str, ...] = ()) -> str:
    """A statement with the CTEs it needs, in order; series are those of the table ``bars``, the adaptive mean of length ``vma``.

    ``made``: what ``bars`` is, if it is no table of its own, and ``of`` what that needs.
    """
    order: list[str] = []
    other = CTES | {"nb": CTES["nb"].replace("FROM h1", f"FROM {bars}"), "wb": _weights(vma)}
    depends = _DEPENDS | {"nb": [bars]}
    if made is not None:
        other[bars], depends[bars] = f"{bars} AS ({made})", list(of)

    def add(name: str) -> None:
        for d in depends.get(name, ()):
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    parts = [other[n] for n in order] + ([extra] if extra else [])
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body

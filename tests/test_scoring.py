import itertools
import random

from pyspark.sql import types as T

from tidebar.operators import combos, desk, scoring

NAMES = [
    "upper_wyckoff_stage", "upper_exh_abs_pa_prior_bar", "middle_wyckoff_stage", "middle_exh_abs_pa_prior_bar", "lower_ma_trend_bullish", "lower_ma_trend_bearish", "lower_exh_abs_pa_prior_bar",
    "lower_macdv_core_bull", "lower_macdv_core_bear", "lower_ttm_squeeze_pro", "middle_sig_vol_current_bar", "lower_sig_vol_prior_bar", "middle_spy_qqq_vol_ma_ratio", "lower_spy_qqq_vol_ma_ratio",
]


def plain(r):
    """The stocks rule restated row by row."""
    gt = lambda a, b: a is not None and a > b
    lt = lambda a, b: a is not None and a < b
    u, ue, m, me = (r[k] for k in NAMES[:4])
    long = (gt(u, 0) or gt(ue, 0)) if u is not None else (gt(m, 0) or gt(me, 0))
    short = (lt(u, 0) or lt(ue, 0)) if u is not None else (lt(m, 0) or lt(me, 0))
    sq = r["lower_ttm_squeeze_pro"]
    bull, bear, exh = r["lower_macdv_core_bull"], r["lower_macdv_core_bear"], r["lower_exh_abs_pa_prior_bar"]
    ls = long + gt(r["lower_ma_trend_bullish"], 0) + (exh in (1, 2)) + (bull == 2 or bull == 1 and sq is not None and sq >= 0)
    ss = short + lt(r["lower_ma_trend_bearish"], 0) + (exh in (-1, -2)) + (bear == -2 or bear == -1 and sq is not None and sq <= 0)
    signal = "short" if ss >= 4 else "long" if ls >= 4 else "none"
    th = 0.05 if u is not None else 0.10
    loud = any(v == 2 and gt(q, th) or v == 1 and gt(q, 0.25) for v, q in ((r[NAMES[10]], r[NAMES[12]]), (r[NAMES[11]], r[NAMES[13]])))
    return signal, float(ls + loud), float(ss + loud)


def table(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        row = {k: rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0, None]) for k in NAMES[:12]} | {k: rng.choice([0.01, 0.07, 0.2, 0.3, None]) for k in NAMES[12:]}
        if i % 3 == 0:  # favour full scores
            s = rng.choice([1.0, -1.0])
            row |= {"upper_wyckoff_stage": s, "lower_ma_trend_bullish": 1.0, "lower_ma_trend_bearish": -1.0, "lower_exh_abs_pa_prior_bar": s, "lower_macdv_core_bull": 2.0, "lower_macdv_core_bear": -2.0}
        rows.append({"symbol": str(i)} | row)
    schema = T.StructType([T.StructField("symbol", T.StringType()), *[T.StructField(k, T.DoubleType()) for k in NAMES]])
    return rows, spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def test_stocks_rule_against_plain_restatement(spark):
    rows, df = table(spark)
    out = {r["symbol"]: (r["signal"], r["mtf_long_score"], r["mtf_short_score"]) for r in scoring.score_combo(df, scoring.stocks_shortlist).collect()}
    assert out == {r["symbol"]: plain(r) for r in rows}
    assert {x[0] for x in out.values()} == {"long", "short", "none"}


def test_options_guardrails(spark):
    base = {"upper_wyckoff_stage": 1.0, "lower_ma_trend_bullish": 1.0, "lower_exh_abs_pa_prior_bar": 1.0, "lower_macdv_core_bull": 2.0, "lower_sig_vol_prior_bar": 2.0, "lower_spy_qqq_vol_ma_ratio": 0.5}
    cases = [(None, None, "long"), (5.0, 0.0, "long"), (3.0, 0.0, "watch"), (5.0, 4.0, "anti")]
    names = ["symbol", *base, "etf_lower_primary_long_score", "etf_lower_primary_short_score"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "symbol" else T.DoubleType()) for n in names])
    df = spark.createDataFrame([(str(i), *base.values(), lo, sh) for i, (lo, sh, _) in enumerate(cases)], schema)
    out = {r["symbol"]: r["signal"] for r in scoring.score_combo(df, scoring.stocks_options).collect()}
    assert out == {str(i): c[2] for i, c in enumerate(cases)}


def test_routes():
    assert scoring.route("stocks", "shortlist_stocks", "daily-weekly-monthly")[1] == "lower_exh_abs_pa_current_bar"
    assert scoring.route("stocks", "unknown", "x")[0] is None
    assert scoring.route("futures", "shortlist_futures", "intraday_4h-daily-weekly")[0] is scoring.futures_4h_d_w


def test_no_evaluator(spark):
    out = scoring.score_combo(spark.createDataFrame([("a",)], "symbol string"), None)
    assert out.columns == ["symbol", "signal", "mtf_long_score", "mtf_short_score"] and out.first()["signal"] == "none"


def test_similarity_ties_go_to_the_first_fund(spark):
    stocks = spark.createDataFrame([("s", "n", "Energy", "Oil Banks"), ("t", "n", None, "x"), ("u", "n", "Zzz", "Qqq")], "symbol string, name string, sector string, industry string")
    funds = spark.createDataFrame([("B", "Banks Fund", 1), ("A", "Bank ETF", 0), ("C", "Energy Select", 2)], "symbol string, name string, pos int")
    over = spark.createDataFrame([("u", "XLE", None, "by hand")], "symbol string, etf_symbol_primary string, etf_symbol_secondary string, notes string")
    out = {r["symbol"]: r for r in combos.match_by_tokens(stocks, funds, over).collect()}
    assert set(out) == {"s", "u"}
    assert (out["s"]["etf_symbol_primary"], out["s"]["etf_symbol_secondary"], out["s"]["etf_match_source"]) == ("A", "C", "fuzzy")
    assert (out["u"]["etf_symbol_primary"], out["u"]["etf_match_source"], out["u"]["etf_override_notes"]) == ("XLE", "override", "by hand")


def test_fingerprint_is_of_all_symbols_in_order(spark):
    import hashlib

    rows = [(f"S{i:03d}", "long") for i in range(51)] + [("b", "watch"), ("a", "watch"), ("A", "Short"), ("z", "none"), ("m", "anti")]
    print_ = lambda rs, *a: desk.fingerprint(spark.createDataFrame(rs, "symbol string, signal string"), *a).first()[0]
    want = "long:" + ",".join(f"S{i:03d}" for i in range(51)) + "|short:A|watch:A,B|anti:M"
    assert print_(rows) == hashlib.sha256(want.encode()).hexdigest()
    assert print_(rows, ["watch", "short"]) == hashlib.sha256(b"watch:A,B|short:A").hexdigest()
    other = [*rows[:50], ("S999", "long"), *rows[51:]]  # beyond the 40 that a digest shows
    assert print_(other) != print_(rows)
    triples = spark.createDataFrame([("b", "Long", " UP "), ("a", "short", None), ("c", "none", "x")], "symbol string, signal string, signal_side string")
    assert desk.fingerprint_rows(triples).first()[0] == '[["A","short",""],["B","long","up"]]'
    assert {tuple(r)[:3] for r in desk.alert_rows(triples).collect()} == {("long", "B", "UP"), ("short", "A", None)}


def test_etf_trend_points(spark):
    df = spark.createDataFrame([("e", 2.0, 2.0, 1.0, 1), ("e", -2.0, 0.0, 0.0, 0), ("f", 2.0, -2.0, 2.0, 2), ("g", None, None, 1.0, 3)], "symbol string, wyckoff_stage double, macdv_guard double, significant_volume double, pos int")
    out = {r["etf_symbol"]: (r["etf_long_score"], r["etf_short_score"]) for r in scoring.etf_trend(df).collect()}
    assert out == {"e": (0.0, 4.0), "f": (4.0, 2.0), "g": (1.0, 1.0)}  # the first row of e; a volume of 2 gives no point


def test_desk(spark):
    df = spark.createDataFrame([(f" s{i:03d}", "Long " if i % 2 else "none", float(i), 0.0) for i in range(101)], "symbol string, signal string, mtf_long_score double, mtf_short_score double")
    digest = desk.alert_digest(df, cap=40).collect()
    assert len(digest) == 1 and digest[0]["n"] == 50 and digest[0]["overflow"] == 10 and len(digest[0]["symbols"].split(",")) == 40
    prints = {desk.fingerprint(x).first()[0] for x in (df, df.orderBy("mtf_long_score"))}
    assert len(prints) == 1
    state = spark.createDataFrame([("k", "old", "1"), ("k", "new", "2")], "alert_key string, fingerprint string, saved_at string")
    now = spark.createDataFrame([("k", "new"), ("j", "x")], "alert_key string, fingerprint string")
    assert [r["alert_key"] for r in desk.changed_only(now, state).collect()] == ["j"]
    assert [r["symbol"] for r in desk.run_screen(df, ["mtf_long_score between 10 and 12"], ["-mtf_long_score"], 2).collect()] == [" s012", " s011"]
    for a, b in itertools.product([None, 3.0, 7.0], repeat=2):
        r = spark.createDataFrame([("a", a, b)], "s string, l double, r double").select(scoring.etf_score(*[scoring.F.col(x) for x in "lr"]).alias("v")).first()["v"]
        assert r == (None if a is None and b is None else max(a or 0.0, b or 0.0))

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebar.functions import text as tx
from tidebar.operators import combos
from tidebar.operators.asof import asof_join

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("stretch", [None, "1 hour", "3 days"])
def test_asof_against_searching(spark, stretch):
    """Ties, gaps over stretches, keys without history, NULL keys and times, clashing columns."""
    rng = random.Random(3)
    t = lambda: None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randrange(0, 6000, 10))
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    history = [(key(), t(), rng.randrange(99)) for _ in range(60)] + [("only", T0, 1)]
    requests = [(k, rng.choice([key(), "none"]), t()) for k in range(300)]
    want = {}
    for i, k, at in requests:
        known = sorted((h, v) for s, h, v in history if s == k and h is not None)
        place = bisect.bisect_right(known, (at, 10**9)) if at else 0
        want[i] = known[place - 1] if place else (None, None)
    left = spark.createDataFrame(requests, "id int, symbol string, at timestamp_ntz").withColumn("v", F.lit("mine"))
    right = spark.createDataFrame(history, "symbol string, at timestamp_ntz, v int")
    out = asof_join(left.repartition(4), right.repartition(3), ["symbol"], "at", stretch)
    assert out.columns == ["id", "symbol", "at", "v", "as_at", "as_v"]
    rows = out.collect()
    assert len(rows) == 300 and {r["v"] for r in rows} == {"mine"}
    assert {r["id"]: (r["as_at"], r["as_v"]) for r in rows} == want
    assert {r["as_v"] for r in asof_join(left, right.limit(0), ["symbol"], "at", stretch).collect()} == {None}


def brute_match(texts, funds):
    """Best fund of each text over all pairs: greatest similarity, then first."""
    out = {}
    for text, t in texts.items():
        scored = [(len(t & f) / len(t | f), -pos, name) for pos, (name, f) in enumerate(funds) if t & f]
        best = max(scored, default=None)
        out[text] = (best[2], round(best[0], 9)) if best else (None, 0.0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_common_tokens_against_all_pairs(spark, seed):
    """Tokens in nearly all funds, texts that share only those, ties between kinds of funds."""
    rng = random.Random(seed)
    common, rare = ["techno", "energo", "metalo"], [f"w{c}x" for c in "abcdefghijkl"]
    name = lambda few: " ".join(w for w in rng.sample(common, rng.randrange(1, 4)) + rng.sample(rare, rng.randrange(*few)))
    names = [name((0, 4)) for _ in range(60)]
    texts = sorted({name((0, 3)) for _ in range(60)} | {"nothing alike", "wax", "..."})
    etfs = spark.createDataFrame([(f"e{k}", n, k) for k, n in enumerate(names)], "symbol string, name string, pos int")
    stocks = spark.createDataFrame([(f"s{k}", "n", "none such", t) for k, t in enumerate(texts)], "symbol string, name string, sector string, industry string")
    tokens = {r["t"]: set(r["k"]) for r in spark.createDataFrame([(t,) for t in {*names, *texts}], "t string").select("t", tx.tokenize(F.col("t")).alias("k")).collect()}
    held = {w: sum(w in tokens[n] for n in names) for w in common}
    assert max(held.values()) > len(names) / 2
    want = brute_match({t: tokens[t] for t in texts}, [(f"e{k}", tokens[n]) for k, n in enumerate(names)])
    got = {r["industry"]: (r["industry_etf"], round(r["industry_score"], 9)) for r in combos.match_by_tokens(stocks, etfs).collect()}
    assert got == want


def test_common_tokens_make_no_pairs(spark):
    """A token of every fund and every text: pairs grow with the kinds, not with the product."""
    etfs = spark.range(400).select(F.concat(F.lit("e"), "id").alias("symbol"), F.concat(F.lit("techno "), F.lit("u"), "id", F.lit("v")).alias("name"), F.col("id").alias("pos"))
    stocks = spark.range(300).select(F.col("id").cast("string").alias("symbol"), F.lit("n").alias("name"), F.lit("techno").alias("sector"), F.concat(F.lit("techno q"), "id", F.lit("z")).alias("industry"))
    out = combos.match_by_tokens(stocks, etfs)
    rows = out.select("industry_etf", "sector_etf").distinct().collect()
    assert [tuple(r) for r in rows] == [("e0", "e0")]
    plan = out._jdf.queryExecution().executedPlan()
    largest = 0
    todo = [plan]
    while todo:  # rows of every join that ran
        node = todo.pop()
        if "Join" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            largest = max(largest, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert largest < 400 * 300 / 10


def test_restriction_runs_no_job(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "symbol string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    some = combos.restrict(df, spark.createDataFrame([("b",), ("b",), ("c",)], "symbol string"))
    every = combos.restrict(df, df.limit(0))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert [r[0] for r in some.collect()] == ["b"] and every.count() == 3

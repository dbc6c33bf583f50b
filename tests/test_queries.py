import math

import duckdb
import pandas as pd
import pytest

from tidebar.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plan_has_one_exchange_and_few_windows(spark, sf_dir):
    from tidebar.operators import frames
    from tidebar.plans import fixtures as fx

    b = fx.hourly(spark, sf_dir).repartition("symbol")
    df = b.select("symbol", "ts", frames.sma("close", 5).alias("a"), frames.sma("close", 20).alias("b"), frames.rmax("high", 9).alias("c"), frames.lag("close").alias("d"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 1 and plan.count("Exchange hashpartitioning(symbol") <= 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

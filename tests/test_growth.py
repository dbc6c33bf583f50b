"""Work that must not be done for every row, or more than once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidebar.operators import combos, scoring
from tidebar.plans import driver_queries, fixtures
from tidebar.sources import bars as src


def optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_texts_are_tokenised_after_they_are_made_distinct(spark):
    """No filter on tokens reaches the rows of stocks, or of what funds are grouped from."""
    stocks = spark.range(50).select(F.col("id").cast("string").alias("symbol"), F.lit("n").alias("name"), F.concat(F.lit("sector "), F.col("id") % 3).alias("sector"), F.concat(F.lit("kind "), F.col("id") % 5).alias("industry"))
    funds = stocks.groupBy(F.concat_ws(" ", "sector", "industry").alias("name")).agg(F.min("symbol").alias("symbol")).withColumn("pos", F.col("symbol").cast("int"))
    lines = optimized(combos.match_by_tokens(stocks, funds))
    assert not [line for line in lines if line.lstrip(" :+-").startswith("Filter") and "regexp_extract_all" in line]


def test_emptiness_of_a_universe_is_seen_from_one_row(spark):
    listed = spark.range(1000).select((F.col("id") % 7).cast("string").alias("symbol"))
    plan = combos.restrict(listed.limit(5), listed)._jdf.queryExecution().optimizedPlan().toString()
    subquery = plan[plan.index("scalar-subquery") :]
    assert "LocalLimit 1" in subquery or "GlobalLimit 1" in subquery


@pytest.mark.parametrize("evaluator", [scoring.stocks_options, scoring.futures_d_w_m])
def test_rules_are_small_enough_to_be_compiled(spark, sf_dir, tmp_path, evaluator):
    """The JVM only interprets methods of more than 8,000 bytes."""
    fixtures.combo(spark, sf_dir).write.parquet(str(tmp_path / "combo"))
    scored = scoring.score_combo(spark.read.parquet(str(tmp_path / "combo")), evaluator)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = scored._jdf.queryExecution().explainString(mode)
    sizes = [int(x.split(";")[0]) for x in text.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000


def test_a_combo_is_made_once_for_both_of_its_tables(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    df = spark.range(20).mapInPandas(count, "id long")
    path, day = str(tmp_path), datetime(2024, 1, 1)
    src.write_combo(df, path, "stocks", "a b=c/d", day)
    assert made.value == 20
    now = spark.read.parquet(f"{path}/current")
    assert now.columns == ["id", "namespace", "combo"] and {tuple(r)[1:] for r in now.collect()} == {("stocks", "a b=c/d")} and now.count() == 20
    assert src.read_combo_asof(spark, path, "stocks", "a b=c/d").count() == 20


def test_a_combo_without_rows_leaves_both_tables(spark, tmp_path):
    """Also under a date that the history has, whose rows are not those of the current combo."""
    path, df = str(tmp_path), spark.createDataFrame([(1.0,)], "x double")
    for day in (1, 2):
        src.write_combo(df.withColumn("x", F.lit(float(day))), path, "stocks", "c", datetime(2024, 1, day))
    none = df.join(df.withColumn("x", F.lit(7.0)), "x")  # empty, which only the job finds out
    for day in (1, 3):
        src.write_combo(none, path, "stocks", "c", datetime(2024, 1, day))
        src.write_combo(df.limit(0), path, "stocks", "c", datetime(2024, 1, day))
    assert [r["x"] for r in spark.read.parquet(f"{path}/current").collect()] == [2.0]
    assert sorted(r["x"] for r in spark.read.parquet(f"{path}/history").collect()) == [1.0, 2.0]


def test_stored_combo_of_the_pipeline(spark, sf_dir):
    rows = driver_queries.combo_pipeline(spark, sf_dir)
    assert rows.select("symbol").distinct().count() == rows.count() > 0

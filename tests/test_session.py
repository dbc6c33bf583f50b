from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidebar.functions import session as ss
from tidebar.operators.repair import bucket_start


def value(spark, expr, ts):
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    return df.select(expr(F.col("ts")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("ts", "expected"),
    [
        (datetime(2024, 1, 5, 17, 59), "2024-01-05"),  # Friday before the roll
        (datetime(2024, 1, 5, 18, 0), "2024-01-08"),  # Friday after it is Monday's
        (datetime(2024, 1, 7, 18, 1), "2024-01-08"),
        (datetime(2024, 1, 3, 18, 0), "2024-01-04"),
    ],
)
def test_trade_date(spark, ts, expected):
    assert str(value(spark, ss.trade_date, ts)) == expected


@pytest.mark.parametrize(
    ("ts", "expected"),
    [
        (datetime(2024, 1, 6, 12, 0), False),
        (datetime(2024, 1, 7, 17, 59), False),
        (datetime(2024, 1, 7, 18, 1), True),
        (datetime(2024, 1, 5, 16, 0), True),
        (datetime(2024, 1, 5, 16, 1), False),
        (datetime(2024, 1, 3, 17, 30), True),
    ],
)
def test_futures_session(spark, ts, expected):
    assert value(spark, ss.in_futures_session, ts) is expected


def test_buckets(spark):
    assert value(spark, ss.bucket_4h, datetime(2024, 1, 3, 0, 30)) == datetime(2024, 1, 2, 21)
    assert value(spark, ss.bucket_4h, datetime(2024, 1, 3, 17, 0)) == datetime(2024, 1, 3, 17)
    assert value(spark, ss.bucket_130m, datetime(2024, 1, 3, 16, 0)) == datetime(2024, 1, 3, 16)
    assert value(spark, ss.bucket_130m, datetime(2024, 1, 3, 11, 39)) == datetime(2024, 1, 3, 9, 30)
    assert value(spark, ss.bucket_130m, datetime(2024, 1, 3, 9, 29)) is None
    for hour in range(24):
        now = datetime(2024, 1, 3, hour, 17)
        assert bucket_start(now, 4) == value(spark, ss.bucket_4h, now)
        assert bucket_start(now, 1) == value(spark, ss.hour_start, now)


def test_iso_year_roll(spark):
    assert value(spark, lambda t: ss.run_key(t, "weekly"), datetime(2024, 12, 30)) == "2025-W01"


def test_time_zone(spark):
    assert value(spark, lambda t: ss.to_new_york(t, "UTC"), datetime(2024, 7, 1, 12)) == datetime(2024, 7, 1, 8)

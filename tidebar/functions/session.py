"""Trading sessions and calendars, all on wall-clock New York time (timestamp without zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import yes


def to_new_york(ts: Column, from_tz: str) -> Column:
    return F.convert_timezone(F.lit(from_tz), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_regular_session(ts: Column) -> Column:
    """09:30 to 16:00, both ends included."""
    return minute_of_day(ts).between(570, 960)


def not_maintenance(ts: Column) -> Column:
    return F.hour(ts) != 17


def in_futures_session(ts: Column) -> Column:
    """Closed on Saturday, from Friday 16:01 and before Sunday 18:01."""
    day, minute = F.weekday(ts), minute_of_day(ts)
    return F.when(day == 5, False).when(day == 6, minute >= 18 * 60 + 1).when(day == 4, minute < 16 * 60 + 1).otherwise(True)


def is_extended_4h_bucket(ts: Column) -> Column:
    """Whether a 4-hour bucket anchored at 17:00 can hold trades."""
    day, hour = F.weekday(ts), F.hour(ts)
    return F.when(day == 5, False).when(day == 6, hour.isin(17, 21)).when(day == 4, hour.isin(1, 5, 9, 13, 17)).otherwise(hour.isin(1, 5, 9, 13, 17, 21))


def trade_date(ts: Column) -> Column:
    """From 18:00 the next day's; what would be Saturday's is Monday's."""
    day = F.to_date(ts + F.expr("INTERVAL 6 HOURS"))
    return F.when(F.weekday(day) == 5, F.date_add(day, 2)).otherwise(day)


def run_key(ts: Column, period: str) -> Column:
    """yyyy-MM-dd, ISO YYYY-Www or yyyy-MM."""
    if period == "weekly":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return F.date_format(ts, {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM"}[period])


def hour_start(ts: Column) -> Column:
    return F.window(ts, "1 hour").start


def bucket_4h(ts: Column) -> Column:
    """Start of the 4-hour bucket of the ladder 17, 21, 1, 5, 9, 13."""
    return F.window(ts, "4 hours", startTime="1 hour").start


def bucket_130m(ts: Column) -> Column:
    """Start of the 130-minute bucket counted from 09:30 of the same day; NULL outside the session."""
    step = F.floor((minute_of_day(ts) - 570) / 130).cast("int")
    start = F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(570) + step * 130)
    return F.when(yes(in_regular_session(ts)), start)

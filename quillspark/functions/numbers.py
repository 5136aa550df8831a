"""Scalar number and time functions as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    c = c.try_cast("double")
    return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)


def ratio(over: Column, under: Column) -> Column:
    """Division of doubles as floating-point numbers have it: by zero infinite, zero by zero NaN."""
    by_zero = F.when(over > 0, float("inf")).when(over < 0, float("-inf")).when(over == 0, float("nan"))
    return F.when(under == 0, F.when(F.isnan(over), over).otherwise(by_zero)).otherwise(F.try_divide(over, under))


def completeness(actual: Column, expected: Column) -> Column:
    """The share that is there, 1 at most; NULL where nothing is expected."""
    share = F.try_divide(actual.cast("double"), expected.cast("double"))
    return F.when(share > 1, 1.0).otherwise(share)  # least() would take 1 for an unknown share


def minutes_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)


def from_epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c)


def from_epoch_s(c: Column, missing: Column) -> Column:
    return F.coalesce(F.timestamp_seconds(c), missing)


def from_iso(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def hour_of(c: Column) -> Column:
    return F.date_trunc("hour", c)


def pull_start(last_run: dt.datetime | None, now: dt.datetime) -> dt.datetime:
    """Where an incremental pull starts: the last run if it is over a day back, else a day back."""
    day = dt.timedelta(hours=24)
    return last_run if last_run is not None and now - last_run > day else now - day


def pull_starts(last_run: Column, now: Column) -> Column:
    """``pull_start`` of each row."""
    day = F.expr("interval 24 hours")
    return F.when(now - last_run > day, last_run).otherwise(now - day)


def stale_by_days(written_at: Column, now: Column, days: int) -> Column:
    """By UTC dates, not by hours; never written counts as stale."""
    return F.coalesce(F.datediff(F.to_date(now), F.to_date(written_at)) >= days, F.lit(True))


def stale_by_hours(written_at: Column, now: Column, hours: float) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(written_at)) / 3.6e9
    return F.coalesce(age >= hours, F.lit(True))

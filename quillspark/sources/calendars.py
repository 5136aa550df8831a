"""Trading calendars from public exchange rules."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One-off closures.
ONE_OFF = [dt.date(2018, 12, 5), dt.date(2025, 1, 9)]


def days(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """(date): every day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def _nth(month: int, weekday: int, n: int) -> Column:
    """The nth given weekday of a month (1: Sunday); the last one for n = -1."""
    d = F.col("date")
    own = (F.month(d) == month) & (F.dayofweek(d) == weekday)
    if n == -1:
        return own & (F.month(F.date_add(d, 7)) != month)
    return own & (F.ceil(F.dayofmonth(d) / 7) == n)


def _fixed(month: int, day: int, saturday: bool = True) -> Column:
    """A date of each year, on Monday if it is a Sunday, and on Friday if it is a Saturday."""
    d = F.col("date")
    at = lambda c: (F.month(c) == month) & (F.dayofmonth(c) == day)
    own = at(d) | (at(F.date_sub(d, 1)) & (F.dayofweek(d) == 2))
    return own | (at(F.date_add(d, 1)) & (F.dayofweek(d) == 6)) if saturday else own


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    whole = lambda c: F.floor(c).cast("int")
    a, b, c = year % 19, whole(year / 100), year % 100
    d, e = whole(b / 4), b % 4
    g = whole((b - whole((b + 8) / 25) + 1) / 3)
    h = (19 * a + b - d - g + 15) % 30
    i, k = whole(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = whole((a + 11 * h + 22 * m) / 451)
    month, day = whole((h + m - 7 * n + 114) / 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year, month, day)


def holiday() -> Column:
    d = F.col("date")
    closed = [
        _fixed(1, 1, saturday=False), _nth(1, 2, 3), _nth(2, 2, 3), d == F.date_sub(easter(F.year(d)), 2), _nth(5, 2, -1),
        _fixed(6, 19) & (F.year(d) >= 2022), _fixed(7, 4), _nth(9, 2, 1), _nth(11, 5, 4), _fixed(12, 25), d.isin(ONE_OFF),
    ]
    return reduce(Column.__or__, closed)


def exchange_calendar(spark: SparkSession, start: dt.date, end: dt.date, asset_class: str = "equities") -> DataFrame:
    """(asset_class, date, market_open, market_close): 09:30 to 16:00 New York time, to 13:00 on half days."""
    wide = days(spark, start - dt.timedelta(days=7), end + dt.timedelta(days=7))
    open_days = wide.where(~F.dayofweek("date").isin(1, 7) & ~holiday())
    d = F.col("date")
    after_thanksgiving = (F.month(d) == 11) & (F.dayofweek(d) == 6) & F.dayofmonth(d).between(23, 29)
    half = after_thanksgiving | ((F.month(d) == 12) & (F.dayofmonth(d) == 24)) | ((F.month(d) == 7) & (F.dayofmonth(d) == 3))
    at = lambda clock: F.to_utc_timestamp(F.concat(d.cast("string"), F.lit(f" {clock}")).cast("timestamp"), "America/New_York")
    rows = open_days.where(d.between(F.lit(start), F.lit(end)))
    return rows.select(F.lit(asset_class).alias("asset_class"), "date", at("09:30:00").alias("market_open"), F.when(half, at("13:00:00")).otherwise(at("16:00:00")).alias("market_close"))


def always_open(spark: SparkSession, start: dt.date, end: dt.date, asset_class: str = "cryptos") -> DataFrame:
    """Every day, whole: 1440 minutes."""
    d = F.col("date").cast("timestamp")
    return days(spark, start, end).select(F.lit(asset_class).alias("asset_class"), "date", d.alias("market_open"), (d + F.expr("interval 1 day")).alias("market_close"))


def numbered(calendar: DataFrame) -> DataFrame:
    """A calendar with each day's place among its class's days."""
    return calendar.withColumn("day_no", F.row_number().over(W.partitionBy("asset_class").orderBy("date")))

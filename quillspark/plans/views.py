"""The test tables in the roles of the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.bars import bars
from quillspark.sources.files import table

EXPECTED_PER_DAY = 70


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with event types as tickers."""
    return bars(events(spark, sf), "hour", ticker="event_type", ts="ts", price="value", order=["ts", "event_id"])


def daily_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with users as tickers."""
    made = bars(events(spark, sf), "day", ticker="user_id", ts="ts", price="value", order=["ts", "event_id"])
    return made.withColumn("ticker", F.col("ticker").cast("string"))


def calendar(spark: SparkSession, sf: str, expected: int) -> DataFrame:
    days = events(spark, sf).agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return days.select(F.lit("cryptos").alias("asset_class"), F.explode(F.sequence("a", "b")).alias("date"), F.lit(expected).alias("expected_minutes"))


def minutes(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return events(spark, sf).groupBy(F.col(key).cast("string").alias("ticker"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean of each event type against 50, with its place in the alphabet."""
    by_day = events(spark, sf).groupBy(F.to_date("ts").alias("ts"), F.col("event_type").alias("asset")).agg(F.round(F.avg("value") - 50, 6).alias("signal"))
    # one window over the distinct names: a universe of assets, not their rows
    pos = by_day.select("asset").distinct().withColumn("asset_pos", F.row_number().over(W.orderBy("asset")))
    return by_day.join(pos, "asset").select("ts", "asset", "asset_pos", "signal")


def holdings(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("string").alias("symbol"), F.lit(1.0).alias("qty"))

"""Bars from ticks, and selections of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bars(ticks: DataFrame, unit: str, *, ticker: str, ts: str, price: str, order: list[str], size: Column | None = None) -> DataFrame:
    """OHLCV bars of a tick table; open and close are the first and last tick by ``order``."""
    key = F.struct(*order)
    return ticks.groupBy(F.col(ticker).alias("ticker"), F.date_trunc(unit, F.col(ts)).cast(dict(ticks.dtypes)[ts]).alias("datetime")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), (F.sum(size) if size is not None else F.count(F.lit(1))).cast("double").alias("volume"),
    )


def select_bars(df: DataFrame, tickers: list[str] | str | None = None, start=None, end=None) -> DataFrame:
    """Bars of some tickers between two instants, both included."""
    if tickers is not None:
        df = df.where(F.col("ticker").isin([tickers] if isinstance(tickers, str) else list(tickers)))
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end))
    return df


def close_matrix(df: DataFrame, tickers: list[str]) -> DataFrame:
    """Closes, a row for each instant and a column for each of the named tickers."""
    return df.groupBy("datetime").pivot("ticker", tickers).agg(F.first("close"))


def incremental_start(df: DataFrame) -> DataFrame:
    """One row: the earliest of the tickers' last dates."""
    return df.groupBy("ticker").agg(F.max("datetime").alias("last")).agg(F.min("last").alias("start"))


def tail(df: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` bars of each ticker."""
    newest = W.partitionBy("ticker").orderBy(F.col("datetime").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def retained(df: DataFrame, as_of: Column, age: str) -> DataFrame:
    """Bars no older than ``age`` (an interval) at ``as_of``, whatever order they came in."""
    return df.where(F.col("datetime") >= as_of - F.expr(f"interval {age}"))


def silent(universe: DataFrame, df: DataFrame, since: Column) -> DataFrame:
    """(ticker, last_seen) of tickers that were never seen, or not after ``since``."""
    seen = df.groupBy("ticker").agg(F.max("datetime").alias("last_seen"))
    return universe.join(seen, "ticker", "left").where(F.coalesce(F.col("last_seen") <= since, F.lit(True)))


def catch_up(history: DataFrame, live: DataFrame, order: list[str]) -> DataFrame:
    """History with live rows over it, one row for each ticker and instant."""
    from quillspark.operators.upsert import upsert

    return upsert(history, live, ["ticker", "datetime"], order)


def from_wide(df: DataFrame, tickers: list[str], fields: list[str]) -> DataFrame:
    """Long bars of a wide table with columns ``{ticker}_{field}``; rows without any value are dropped."""
    rows = F.array(*(F.struct(F.lit(t).alias("ticker"), *(F.col(f"{t}_{f}").cast("double").alias(f) for f in fields)) for t in tickers))
    long = df.select("datetime", F.explode(rows).alias("r")).select("datetime", "r.*")
    return long.dropna(how="all", subset=fields)

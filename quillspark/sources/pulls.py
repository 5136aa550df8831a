"""Pulls from services into versioned tables: resumable backfills, incremental histories, and reads behind a staleness rule.

What a service gives is read once for each chunk of tickers (``read``, a function of a table of tickers), settled, and
written; the ledger is written after it. A pull that ends anywhere goes on from there when it is started again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.bars import incremental_start
from quillspark.operators.numbering import numbered_chunks
from quillspark.operators.screening import not_done
from quillspark.sources.files import stale
from quillspark.sources.rest import BarSource
from quillspark.sources.shared import settled
from quillspark.sources.versions import VersionedTable

BARS = ["ticker", "datetime", "open", "high", "low", "close", "volume"]
Read = Callable[[DataFrame], DataFrame]


def rest_read(spark: SparkSession, **options: str) -> Read:
    """Bars of tickers with status and error from a service (``rest``'s options). The names of one chunk go into the request."""
    spark.dataSource.register(BarSource)

    def read(tickers: DataFrame) -> DataFrame:
        names = ",".join(r[0] for r in tickers.orderBy("ticker").collect())  # one chunk
        return spark.read.format("rest_bars").options(**options, errors="rows", tickers=names).load()

    return read


def ledger_of(rows: DataFrame, now: Column) -> DataFrame:
    """A ledger row for each ticker of what a service gave: its status, bars, span and error."""
    found = rows.groupBy("ticker").agg(F.max("status").alias("status"), F.count("datetime").alias("n_bars"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.max("error").alias("error"))
    return found.withColumn("fetched_at", now)


def backfill(tickers: DataFrame, bars: VersionedTable, ledger: VersionedTable, read: Read, now: Column, *, every: int = 25, force: bool = False, growth: int = 1) -> int:
    """Bars of all tickers that are not done, in chunks of ``every``: their bars are durable before their ledger rows. Returns the number of chunks.

    Failed tickers do not touch the others; they and those never tried are pending when this is called again.
    A round takes one chunk, or ``growth`` times as many as the round before: with 2 or more the number of rounds grows with the logarithm of the
    tickers, and all rounds together rewrite a bounded multiple of the bars. A call that ends anywhere loses the round that it was in.
    """
    known = ledger.read()
    pending = tickers.select("ticker").distinct()
    if known is not None and not force:
        pending = not_done(pending, known)
    chunks = settled(numbered_chunks(pending, "ticker", every))
    last = chunks.agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    start, size = 0, 1
    while start <= last:
        got = settled(read(chunks.where((F.col("batch") >= start) & (F.col("batch") < start + size)).select("ticker")))
        bars.merge(got.where("datetime is not null").select(BARS), uuid.uuid4().hex)
        ledger.merge(ledger_of(got, now), uuid.uuid4().hex)
        start, size = start + size, size * growth
    return int(last) + 1


def pull_history(tickers: DataFrame, bars: VersionedTable, read_from: Callable[[DataFrame, object], DataFrame]) -> dict | None:
    """Daily bars of new tickers from the beginning (``read_from`` with None), of those held from the earliest of their last days; None where the service gives none."""
    wanted, held = tickers.select("ticker").distinct(), bars.read()
    if held is None:
        got = read_from(wanted, None)
    else:
        old = wanted.join(held.select("ticker").distinct(), "ticker", "left_semi")
        start = incremental_start(held.join(old, "ticker", "left_semi")).first()["start"]  # one instant
        got = read_from(wanted.join(held, "ticker", "left_anti"), None)
        if start is not None:
            got = got.unionByName(read_from(old, start))
    got = settled(got.select(BARS))
    return None if got.isEmpty() else bars.merge(got, uuid.uuid4().hex)


def pull_minutes(equities: DataFrame, cryptos: DataFrame, bars: VersionedTable, read_equities: Read, read_cryptos: Read) -> dict | None:
    """One-minute bars of both classes in one version."""
    got = settled(read_equities(equities).select(BARS).unionByName(read_cryptos(cryptos).select(BARS)).where("datetime is not null"))
    return None if got.isEmpty() else bars.merge(got, uuid.uuid4().hex)


def routes(symbols: DataFrame) -> DataFrame:
    """(ticker, asset_class, history, minutes) of new symbols (ticker, quote_type): unknown ones are left out; cryptos have no daily history."""
    crypto = F.col("quote_type") == "CRYPTOCURRENCY"
    known = symbols.where("quote_type is not null and quote_type <> ''")
    return known.select("ticker", F.when(crypto, "cryptos").otherwise("equities").alias("asset_class"), (~crypto).alias("history"), F.lit(True).alias("minutes"))


def read_through(table: VersionedTable, fetch: Callable[[], DataFrame], now: str, *, freq: str | None = None, hours: float | None = None, force: bool = False) -> DataFrame:
    """The table as it is while it is fresh; else what ``fetch`` gives, which becomes the table. ``now`` is an instant as text (UTC)."""
    spark, at = table.spark, table.manifest()
    control = spark.createDataFrame([("t", at["written_at"])] if at else [], "name string, written_at string").withColumn("written_at", F.to_timestamp("written_at"))
    names = spark.createDataFrame([("t",)], "name string")
    if stale(control, names, F.lit(now).cast("timestamp"), freq=freq, hours=hours, force=force).first()["stale"]:
        table.replace(settled(fetch()), uuid.uuid4().hex, written_at=now)
    return table.read()

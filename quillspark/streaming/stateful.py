"""Stateful operators with typed state: bars seeded from history, and held books that a watchlist ends.

Both need the RocksDB state store (``state_session``). State has a declared schema, so it can be read by other versions
of Python and of this library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDGE = "at timestamp, seq bigint"
PARTIAL = "first_at timestamp, first_seq bigint, open double, high double, low double, last_at timestamp, last_seq bigint, close double, volume double"
BAR = "ticker string, datetime timestamp, open double, high double, low double, close double, volume double"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that these operators need; the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def partial_bars(ticks: DataFrame, *, ticker: str, ts: str, price: str, order: str, width: str = "1 hour") -> DataFrame:
    """Bars with the place of their first and last tick, so that two parts of one bar can be put together: the initial state of ``seeded_bars``."""
    key = F.struct(F.col(ts).alias("at"), F.col(order).cast("long").alias("seq"))
    made = ticks.groupBy(F.col(ticker).alias("ticker"), F.window(ts, width)["start"].alias("datetime")).agg(
        F.min(key).alias("first"), F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max(key).alias("last"), F.max_by(price, key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return made.select("ticker", "datetime", F.col("first.at").alias("first_at"), F.col("first.seq").alias("first_seq"), "open", "high", "low", F.col("last.at").alias("last_at"), F.col("last.seq").alias("last_seq"), "close", "volume")


class _Bars(StatefulProcessor):
    """One bar of one ticker: what came so far, put together with each batch's ticks."""

    def __init__(self, retention_ms: int | None):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", PARTIAL, self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.bar.get() if self.bar.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values(["at", "seq"])
            first, last = pdf.iloc[0], pdf.iloc[-1]
            low, high, n = float(pdf["price"].min()), float(pdf["price"].max()), float(len(pdf))
            start, end = (first["at"].to_pydatetime(), int(first["seq"])), (last["at"].to_pydatetime(), int(last["seq"]))
            o, c = float(first["price"]), float(last["price"])
            if held is not None:
                a_at, a_seq, a_open, a_high, a_low, z_at, z_seq, z_close, volume = held
                if (a_at, a_seq) <= start:
                    start, o = (a_at, a_seq), a_open
                if (z_at, z_seq) > end:
                    end, c = (z_at, z_seq), z_close
                high, low, n = max(high, a_high), min(low, a_low), n + volume
            held = (*start, o, high, low, *end, c, n)
        self.bar.update(held)
        yield pd.DataFrame({"ticker": [key[0]], "datetime": [key[1]], "open": [held[2]], "high": [held[3]], "low": [held[4]], "close": [held[7]], "volume": [held[8]]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.bar.update((r["first_at"].to_pydatetime(), int(r["first_seq"]), float(r["open"]), float(r["high"]), float(r["low"]), r["last_at"].to_pydatetime(), int(r["last_seq"]), float(r["close"]), float(r["volume"])))

    def close(self) -> None:
        pass


def seeded_bars(ticks: DataFrame, history: DataFrame, *, ticker: str, ts: str, price: str, order: str, width: str = "1 hour", retention: str | None = None) -> DataFrame:
    """Bars of a stream of ticks that go on where ``history`` (``partial_bars`` of what came before) ends; in update mode each batch brings the bars that it changed.

    State is kept by ticker and bar, so a busy ticker is spread over its bars. ``retention`` (an interval) ends the state of a bar that long after its last tick came.
    """
    milliseconds = None if retention is None else int(pd.Timedelta(retention).total_seconds() * 1000)
    rows = ticks.where(F.col(ts).isNotNull()).select(F.col(ticker).cast("string").alias("ticker"), F.window(ts, width)["start"].alias("datetime"), F.col(ts).alias("at"), F.col(order).cast("long").alias("seq"), F.col(price).cast("double").alias("price"))
    seed = history.withColumn("ticker", F.col("ticker").cast("string")).groupBy("ticker", "datetime")
    return rows.groupBy("ticker", "datetime").transformWithStateInPandas(_Bars(milliseconds), BAR, "Update", "None" if milliseconds is None else "ProcessingTime", initialState=seed)


class _Books(StatefulProcessor):
    """The last book of one code, repeated by a timer until a drop row ends it. Rows (at, book, dropped) have microseconds and JSON, which is parsed for the newest book alone."""

    def __init__(self, every_ms: int, ttl_ms: int | None):
        self.every_ms, self.ttl_ms = every_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        side = "array<struct<price: double, size: double>>"
        self.book = handle.getValueState("book", f"at timestamp, bids {side}, asks {side}", self.ttl_ms)

    def _cancel(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def _repeat(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, dropped = None, None
        for code, at, book, off in rows:
            if at is None:
                continue
            if off:
                dropped = at if dropped is None else max(dropped, at)
            elif newest is None or (at, book) > newest:
                newest = at, book
        # each call on state is a message to the JVM: a code that comes for the first time needs few of them
        timed = holds = self.book.exists()
        if holds:
            held = _micros(self.book.get()[0])
            if dropped is not None and dropped >= held:
                self.book.clear()
                holds = False
            elif newest is not None and newest[0] < held:
                newest = None
        fresh = newest is not None and (dropped is None or newest[0] > dropped)
        if (fresh or not holds) and (timed or self.ttl_ms is not None):  # a book that its ttl ended leaves its timer
            self._cancel()
        if fresh:
            sides = json.loads(newest[1])
            held = (EPOCH + timedelta(microseconds=newest[0]), _levels(sides.get("bids")), _levels(sides.get("asks")))
            self.book.update(held)
            self._repeat(timerValues)
            yield _row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.book.exists():
            self._repeat(timerValues)
            yield _row(key, self.book.get(), True)

    def close(self) -> None:
        pass


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(at: datetime) -> int:
    return (at.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def _levels(side) -> list[tuple[float | None, float | None]]:
    """(price, size) of the levels of a parsed side; JSON writes numbers that are not finite as strings."""
    number = lambda x: None if x is None else float(x)
    return [(number(x.get("price")), number(x.get("size"))) for x in ((y or {}) for y in side or [])]


def _row(key, held, repeated: bool) -> Row:
    at, bids, asks = held
    side = lambda levels: [Row(price=x[0], size=x[1]) for x in levels]
    return Row(code=key[0], ts=at.astimezone(timezone.utc), bids=side(bids), asks=side(asks), repeated=repeated)


def hold_books(books: DataFrame, drops: DataFrame, every: str = "1 second", ttl: str | None = None) -> DataFrame:
    """The last book of each code (code, ts, bids, asks), again at every interval without a new one, until a row of ``drops`` (code, ts) takes the code off.

    A drop removes the state of its code at once: nothing is emitted for it until a later book comes. ``ttl`` removes the state of codes that fell silent.
    Of books of one time the greatest by their JSON is taken; rows without a time are passed over.
    """
    side = "array<struct<price: double, size: double>>"
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    book = F.to_json(F.struct(F.col("bids").cast(side).alias("bids"), F.col("asks").cast(side).alias("asks"))).alias("book")
    rows = books.select("code", at, book, F.lit(False).alias("dropped"))
    off = drops.select("code", at, F.lit(None).cast("string").alias("book"), F.lit(True).alias("dropped"))
    ms = lambda t: None if t is None else int(pd.Timedelta(t).total_seconds() * 1000)
    out = f"code string, ts timestamp, bids {side}, asks {side}, repeated boolean"
    return rows.unionByName(off).groupBy("code").transformWithState(_Books(ms(every), ms(ttl)), out, "Update", "ProcessingTime")

"""Structured Streaming: live bars, deduplication, sinks and polling strategies. Held books and seeded bars are in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.decisions import Strategy
from quillspark.operators.upsert import upsert


def read_files(spark: SparkSession, path: str, schema: str | StructType, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_bars(ticks: DataFrame, *, ticker: str, ts: str, price: str, order: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """OHLCV bars by event time; state older than ``late`` is dropped, and so are rows later than that."""
    key = F.struct(ts, order)
    grouped = ticks.withWatermark(ts, late).groupBy(F.col(ticker).alias("ticker"), F.window(ts, width).alias("w"))
    made = grouped.agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return made.select("ticker", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume")


def unique_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Each bar once, with state bounded by a watermark."""
    return bars.withWatermark("datetime", late).dropDuplicatesWithinWatermark(["ticker", "datetime"])


def write_flushes(df: DataFrame, path: str, checkpoint: str, date: str = "date", every: str | None = "30 seconds"):
    """Immutable zstd files in a folder for each date; the commit log makes them exactly-once. Without ``every``, what is there is written and the query ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy(date)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def upsert_batches(existing: Callable[[], DataFrame | None], save: Callable[[DataFrame, int], None], keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a table; applying a batch twice changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        old = existing()
        save(upsert(old if old is not None else batch.limit(0), batch, keys, order), batch_id)

    return apply


def publish(batch: DataFrame) -> DataFrame:
    """Rows as a message sink takes them: key is the ticker, value the bar as JSON, times to the microsecond."""
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return batch.select(F.col("ticker").alias("key"), F.to_json(F.struct("*"), times).alias("value"))


def run_strategy(strategy: Strategy, bars: Callable[[], DataFrame], positions: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that decides on the tables as they are after each batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        emit(strategy(bars(), positions()), batch_id)

    return apply


def subscriptions(batch: DataFrame, watchlist: DataFrame) -> DataFrame:
    """The rows of watched tickers, by exact name; the list is read anew for each batch, and broadcast if Spark finds it small."""
    return batch.join(watchlist, "ticker", "left_semi")

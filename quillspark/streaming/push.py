"""A streaming source for pushes of bars and books, and a transactional sink for messages.

The source reads a log of numbered messages that a service (or a receiver beside it) keeps until they are acknowledged. The
transport is a class named by ``module:Class`` and made with the options: ``first()`` and ``end()`` are the numbers of the oldest
message that is kept and of the next one to come, ``fetch(start, end)`` gives (number, ticker, kind, body) in order, ``acknowledge(end)`` lets go of what is
before. Offsets are message numbers, so a batch that is run again after a restart reads the same messages. Tasks fetch their own ranges.

The sink stages each task's messages in a file of its own and publishes a batch by one manifest, renamed into place when all tasks
have ended; readers see the files that manifests name. A batch that is committed again changes nothing, and a failed one leaves nothing to see.

Both folders must be mounted by the driver and all executors (the sink's, and the log's where ``FolderLog`` is used).
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

BAR = "datetime string, open double, high double, low double, close double, volume double"
BOOK = "ts string, bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>"


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))


class FolderLog:
    """Messages in files of JSON lines named by the numbers that they hold; a file is put in place whole."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["folder"]

    def _files(self) -> list[tuple[int, int, str]]:
        names = [n for n in os.listdir(self.folder) if n.endswith(".jsonl")] if os.path.isdir(self.folder) else []
        return sorted((*map(int, n.removesuffix(".jsonl").split("-")), os.path.join(self.folder, n)) for n in names)

    def first(self) -> int:
        files = self._files()
        return files[0][0] if files else self._acknowledged()

    def end(self) -> int:
        files = self._files()
        return files[-1][1] if files else self._acknowledged()

    def _acknowledged(self) -> int:
        try:
            with open(os.path.join(self.folder, "acknowledged")) as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def fetch(self, start: int, end: int) -> Iterator[tuple[int, str, str, str]]:
        for low, high, path in self._files():
            if low < end and high > start:
                with open(path) as f:
                    for number, line in enumerate(f, low):
                        if start <= number < end:
                            m = json.loads(line)
                            yield number, m["ticker"], m["kind"], json.dumps(m["body"])

    def acknowledge(self, end: int) -> None:
        """Forget files whose messages are all before ``end``."""
        done = [(high, path) for _, high, path in self._files() if high <= end]
        if done:
            _put(os.path.join(self.folder, "acknowledged"), str(max(self._acknowledged(), done[-1][0])))
            for _, path in done:
                os.remove(path)

    def append(self, messages: list[dict]) -> None:
        """What a receiver calls: messages (ticker, kind, body) get the next numbers."""
        os.makedirs(self.folder, exist_ok=True)
        if messages:
            start = self.end()
            _put(os.path.join(self.folder, f"{start:020d}-{start + len(messages):020d}.jsonl"), "".join(json.dumps(m) + "\n" for m in messages))


def _put(path: str, text: str) -> None:
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    with open(aside, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


class PushReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        module, _, name = options.get("transport", f"{__name__}:FolderLog").partition(":")
        self.log = getattr(importlib.import_module(module), name)(options)

    def initialOffset(self) -> dict:
        return {"next": self.log.first()}

    def latestOffset(self, *_) -> dict:
        return {"next": self.log.end()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["next"], end["next"]
        if low < high and self.log.first() > low:
            raise RuntimeError(f"messages from {low} on are no longer kept: the log begins at {self.log.first()}")
        size = int(self.options.get("per_partition", "10000"))
        return [Range(i, min(high, i + size)) for i in range(low, high, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value
        n = 0
        for row in self.log.fetch(start, end):
            n += 1
            yield row
        if n != end - start:
            raise RuntimeError(f"{n} messages from {start} to {end}")

    def commit(self, end: dict) -> None:
        self.log.acknowledge(end["next"])


class PushSource(DataSource):
    """``spark.readStream.format("push_log")`` with options folder, or transport and its own ones, and per_partition."""

    @classmethod
    def name(cls) -> str:
        return "push_log"

    def schema(self) -> str:
        return "number bigint, ticker string, kind string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PushReader(dict(self.options))


def pushed_bars(pushes: DataFrame) -> DataFrame:
    """ticker, datetime, open, high, low, close, volume, number of the pushed bars; a body that does not parse gives nulls."""
    bar = F.from_json("body", BAR)
    return pushes.where("kind = 'bar'").select("ticker", bar.alias("b"), "number").select("ticker", F.try_to_timestamp("b.datetime").alias("datetime"), "b.open", "b.high", "b.low", "b.close", "b.volume", "number")


def pushed_books(pushes: DataFrame) -> DataFrame:
    """code, ts, bids, asks of the pushed books, as ``hold_books`` takes them."""
    return pushes.where("kind = 'book'").select(F.col("ticker").alias("code"), F.from_json("body", BOOK).alias("b")).select("code", F.try_to_timestamp("b.ts").alias("ts"), "b.bids", "b.asks")


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


class MessageWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def write(self, iterator) -> WriterCommitMessage:
        """A task's messages, in order, in a file that no manifest names yet."""
        os.makedirs(os.path.join(self.folder, "data"), exist_ok=True)
        path = os.path.join(self.folder, "data", f"{uuid.uuid4().hex}.jsonl")
        rows = 0
        try:
            with open(path, "w") as f:
                for row in iterator:
                    f.write(json.dumps({c: row[c] for c in self.columns}) + "\n")
                    rows += 1
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.remove(path)
            raise
        return Staged(path, rows)

    def commit(self, messages: list, batchId: int) -> None:
        staged = [m for m in messages if m is not None]
        manifest = os.path.join(self.folder, f"batch-{batchId:012d}.json")
        if os.path.exists(manifest):  # committed before a restart: this run's files are not needed
            self.abort(messages, batchId)
            return
        _put(manifest, json.dumps({"batch": batchId, "files": [m.path for m in staged if m.rows]}))
        for m in staged:
            if not m.rows:
                os.remove(m.path)

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class MessageSink(DataSource):
    """``writeStream.format("message_log")`` for (key, value): one message for each row, published batch by batch. Rows of a key are in order in its file where the stream is repartitioned by key."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if schema.fieldNames() != ["key", "value"]:
            raise ValueError("a message has a key and a value")
        return MessageWriter(self.options["folder"], ["key", "value"])


def read_messages(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """The published messages (batch, key, value), of some keys if given."""
    batches = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.startswith("batch-") and name.endswith(".json"):
            with open(os.path.join(folder, name)) as f:
                batches.append(json.load(f))
    files = spark.createDataFrame([(m["batch"], os.path.basename(p)) for m in batches for p in m["files"]], "batch long, file string")
    paths = [p for m in batches for p in m["files"]]
    if not paths:
        return spark.createDataFrame([], "batch long, key string, value string")
    rows = spark.read.schema("key string, value string").json(paths).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = rows.join(files, "file").select("batch", "key", "value")
    return rows if keys is None else rows.where(F.col("key").isin(keys))

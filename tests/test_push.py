"""The push source and the message sink: nothing is lost, nothing comes twice."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.plans import feeds
from quillspark.streaming import push


def bar(ticker, minute, close):
    return {"ticker": ticker, "kind": "bar", "body": {"datetime": f"2024-01-01 10:{minute:02d}:00", "open": 1, "high": 2, "low": 0.5, "close": close, "volume": 3}}


def book(ticker, price):
    return {"ticker": ticker, "kind": "book", "body": {"ts": "2024-01-01 10:00:00", "bids": [{"price": price, "size": 1}], "asks": []}}


@pytest.fixture
def registered(spark):
    spark.dataSource.register(push.PushSource)
    spark.dataSource.register(push.MessageSink)
    return spark


def drained(df, log, sink):
    """All there is now goes to the sink; then the query ends, as at a restart."""
    query = df.writeStream.format("message_log").option("folder", str(sink)).option("checkpointLocation", str(log)).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_restart_loses_and_repeats_nothing(registered, tmp_path):
    spark, log = registered, push.FolderLog({"folder": str(tmp_path / "pushes")})
    pushes = spark.readStream.format("push_log").option("folder", str(tmp_path / "pushes")).option("per_partition", "3").load()
    messages = push.pushed_bars(pushes).repartition(2, "ticker").select(F.col("ticker").alias("key"), F.to_json(F.struct("*")).alias("value"))
    sent = []
    for run in range(3):
        for _ in range(2):
            batch = [bar(t, run, c) for t in ("A", "B", "C") for c in (1.0, 2.0)] + [book("A", 9.0)]
            log.append(batch)
            sent += batch
        drained(messages, tmp_path / "log", tmp_path / "out")
    rows = push.read_messages(spark, str(tmp_path / "out")).collect()
    numbers = [json.loads(r.value)["number"] for r in rows]
    assert sorted(numbers) == [i for i, m in enumerate(sent) if m["kind"] == "bar"]
    assert {r.key for r in push.read_messages(spark, str(tmp_path / "out"), ["B"]).collect()} == {"B"}
    assert len(log._files()) < 6 and log.end() == len(sent)  # what is committed is let go of


def test_uncommitted_batch_is_read_again(registered, tmp_path):
    """A batch that failed in the sink is read again from the same numbers; the failed tasks leave no message."""
    spark, log = registered, push.FolderLog({"folder": str(tmp_path / "pushes")})
    log.append([bar("A", 1, 1.0), bar("B", 1, 2.0), bar("C", 1, 3.0)])
    flag = tmp_path / "broken"
    flag.touch()
    path = str(flag)

    @F.udf("string")
    def fragile(value):
        if '"B"' in value and os.path.exists(path):
            raise RuntimeError("no connection")
        return value

    pushes = spark.readStream.format("push_log").option("folder", str(tmp_path / "pushes")).option("per_partition", "1").load()
    messages = push.pushed_bars(pushes).select(F.col("ticker").alias("key"), fragile(F.to_json(F.struct("*"))).alias("value"))
    with pytest.raises(StreamingQueryException):
        drained(messages, tmp_path / "log", tmp_path / "out")
    assert push.read_messages(spark, str(tmp_path / "out")).count() == 0
    log.append([bar("D", 2, 4.0)])
    flag.unlink()
    drained(messages, tmp_path / "log", tmp_path / "out")
    rows = push.read_messages(spark, str(tmp_path / "out")).collect()
    assert sorted((r.batch, r.key) for r in rows) == [(0, "A"), (0, "B"), (0, "C"), (1, "D")]
    kept = {os.path.basename(f) for f in os.listdir(tmp_path / "out" / "data")}
    named = {os.path.basename(p) for n in os.listdir(tmp_path / "out") if n.startswith("batch-") for p in json.loads((tmp_path / "out" / n).read_text())["files"]}
    assert named <= kept


def test_commit_again_changes_nothing(tmp_path):
    writer = push.MessageWriter(str(tmp_path), ["key", "value"])
    for _ in range(2):
        writer.commit([writer.write(iter([{"key": "A", "value": "1"}])), writer.write(iter([])), None], 4)
    assert len(os.listdir(tmp_path / "data")) == 1 and len([n for n in os.listdir(tmp_path) if n.startswith("batch-")]) == 1


def test_lost_messages_are_an_error(registered, tmp_path):
    log = push.FolderLog({"folder": str(tmp_path)})
    log.append([bar("A", 1, 1.0)] * 3)
    log.append([bar("A", 2, 1.0)] * 3)
    log.acknowledge(3)
    reader = push.PushReader({"folder": str(tmp_path)})
    assert reader.initialOffset() == {"next": 3} and reader.latestOffset() == {"next": 6}
    with pytest.raises(RuntimeError, match="no longer kept"):
        reader.partitions({"next": 1}, {"next": 6})
    log.acknowledge(6)
    assert reader.latestOffset() == {"next": 6} and reader.partitions({"next": 6}, {"next": 6}) == []
    log.append([bar("A", 3, 1.0)])
    assert log.end() == 7


def test_books(spark):
    rows = spark.createDataFrame([(0, "A", "book", json.dumps(book("A", 9.0)["body"])), (1, "A", "bar", "{}"), (2, "B", "book", "no json")], "number long, ticker string, kind string, body string")
    got = push.pushed_books(rows).orderBy("code").collect()
    assert [(r.code, r.ts and r.ts.hour, r.bids and r.bids[0].price) for r in got] == [("A", 10, 9.0), ("B", None, None)]


def test_event_log_reads_its_range(spark, tmp_path, monkeypatch):
    """A range of messages is read from its row groups up to its end, not as whole row groups; any two ranges that meet give what one gives."""
    ev = pq.read_table("/root/testdata/sf0.01/events.parquet").slice(0, 50_000)
    path = str(tmp_path / "events.parquet")
    pq.write_table(pa.concat_tables([ev] * 8), path, row_group_size=60_000)
    log, read = feeds.EventLog({"path": path}), []

    class Counted(pq.ParquetFile):
        def iter_batches(self, *args, **options):
            for batch in super().iter_batches(*args, **options):
                read.append(batch.num_rows)
                yield batch

        def read_row_group(self, *args, **options):
            read.append((found := super().read_row_group(*args, **options)).num_rows)
            return found

    monkeypatch.setattr(feeds.pq, "ParquetFile", Counted)
    n = log.end()
    assert n == 16 * ev.num_rows
    whole = list(log.fetch(0, n))
    assert [m[0] for m in whole] == list(range(n)) and sum(read) == n // 2
    for start, end in ((0, 1), (1, 2), (3, 3), (119_999, 120_003), (32_767, 32_769), (100_001, 140_000), (n - 1, n)):
        assert list(log.fetch(start, end)) == whole[start:end]
    read.clear()
    list(log.fetch(0, 1000))
    assert sum(read) <= 20_000

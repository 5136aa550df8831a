"""Versioned tables, seeded streams and held books."""

import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.operators.bars import bars
from quillspark.sources.versions import BucketedTable, VersionedTable
from quillspark.streaming import live, stateful

SF = "/root/testdata/sf0.001"


def bar_table(spark, root):
    return VersionedTable(spark, str(root), ["ticker", "datetime"], ["close"], F.to_date("datetime"))


def day_bars(spark, *rows):
    return spark.createDataFrame([(t, d, c) for t, d, c in rows], "ticker string, datetime string, close double").withColumn("datetime", F.to_timestamp("datetime"))


def contents(table):
    return sorted((r.ticker, r.datetime.isoformat(), r.close) for r in table.read().collect())


def test_versions(spark, tmp_path):
    table = bar_table(spark, tmp_path)
    assert table.read() is None
    table.merge(day_bars(spark, ("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-02 10:00:00", 2.0)), 0)
    first = table.manifest()
    table.merge(day_bars(spark, ("A", "2024-01-02 10:00:00", 5.0), ("B", "2024-01-02 10:00:00", 3.0)), 1)
    assert contents(table) == [("A", "2024-01-01T10:00:00", 1.0), ("A", "2024-01-02T10:00:00", 5.0), ("B", "2024-01-02T10:00:00", 3.0)]
    assert table.read(first).count() == 2  # a reader of the version before
    assert table.manifest()["parts"]["=2024-01-01"] == first["parts"]["=2024-01-01"]  # an untouched day is not rewritten
    table.merge(day_bars(spark, ("A", "2024-01-02 10:00:00", 9.0)), 1)  # batch 1 again
    assert [r["batch"] for r in table.ledger()] == [0, 1] and ("A", "2024-01-02T10:00:00", 9.0) not in contents(table)
    assert len(table.vacuum()) == 1 and len(contents(table)) == 3  # one old manifest; both data folders are still in use


@pytest.mark.parametrize("where", ["_versions", "_ledger"])
def test_killed_between(spark, tmp_path, monkeypatch, where):
    """A run that ends before the manifest or before the ledger row, and is run again: one version, one row."""
    table, batch = bar_table(spark, tmp_path), day_bars(spark, ("A", "2024-01-01 10:00:00", 1.0))
    real = VersionedTable._put

    def put(self, name, value):
        if name.startswith(where):
            raise KeyboardInterrupt
        real(self, name, value)

    monkeypatch.setattr(VersionedTable, "_put", put)
    with pytest.raises(KeyboardInterrupt):
        table.merge(batch, 7)
    assert table.ledger() == [] and (table.manifest() is None) == (where == "_versions")
    monkeypatch.undo()
    again = bar_table(spark, tmp_path)
    again.merge(batch, 7)
    assert len(again.versions()) == 1 and again.ledger() == [{"batch": 7, "version": 0, "rows": 1}]
    assert len(contents(again)) == 1
    assert len(again.vacuum()) == (where == "_versions")  # the data that no manifest names


def test_odd_parts_and_empty_batches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["k"], ["v"], F.col("p"))
    rows = [("a", 1, "x=1/2 %"), ("b", 2, None), ("c", 3, "")]
    table.merge(spark.createDataFrame(rows, "k string, v int, p string"), 0)
    table.merge(spark.createDataFrame([("a", 5, "x=1/2 %"), ("b", 6, None)], "k string, v int, p string"), 1)
    table.merge(spark.createDataFrame([], "k string, v int, p string"), 2)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [("a", 5), ("b", 6), ("c", 3)]
    assert [m["batch"] for m in table.versions()] == [0, 1, 2]


def test_buckets_meet_a_batch_unshuffled(spark, tmp_path, monkeypatch):
    """Only the buckets of a batch's keys are rewritten, and no exchange stands over the history's scan."""
    table = BucketedTable(spark, str(tmp_path), ["ticker", "minute"], ["seq"], 8)
    rows = lambda n, seq: spark.range(n).selectExpr("cast(id % 50 AS string) AS ticker", "cast(id AS int) AS minute", f"{seq} AS seq")
    table.merge(rows(1000, 0), 0)
    first, plans = table.manifest(), []
    real = BucketedTable._save
    monkeypatch.setattr(BucketedTable, "_save", lambda self, df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(self, df, path)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a batch of any size
    try:
        table.merge(rows(2, 1).unionByName(rows(1, 2)).withColumn("minute", F.col("minute").cast("long")), 1)  # a repeated key, and a wider type
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    second = table.manifest()
    changed = {p for p in second["parts"] if second["parts"][p] != first["parts"][p]}
    assert len(first["parts"]) == 8 and 1 <= len(changed) <= 2
    got = {(r.ticker, r.minute): r.seq for r in table.read().collect()}
    assert table.read().count() == len(got) == 1000
    assert {k: v for k, v in got.items() if v} == {("0", 0): 2, ("1", 1): 1}
    history = next(i for i, line in enumerate(plans[0].split("\n")) if "Bucketed: true" in line)
    lines = plans[0].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    over = [depth(lines[history])]
    for line in reversed(lines[:history]):  # the operators that stand over the scan
        if depth(line) < over[-1]:
            over.append(depth(line))
            assert "Exchange" not in line
    with table.bucketed() as held:
        assert "Exchange" not in held.groupBy("ticker", "minute").count()._jdf.queryExecution().executedPlan().toString()
    table.vacuum()
    assert table.read().count() == 1000 and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_buckets_refuse_null_keys_and_other_columns(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["k"], ["v"], 4)
    table.merge(spark.createDataFrame([], "k int, v int"), 0)
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), 1)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(None, 1)], "k int, v int"), 2)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(1, 1, 1)], "k int, v int, w int"), 2)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)] and [r["batch"] for r in table.ledger()] == [0, 1]


def test_stream_goes_on_from_history(spark, tmp_path):
    """A stream over the second half of the events, seeded with bars of the first half, gives the bars of all events, in many batches and across a restart."""
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    names = dict(ticker="event_type", ts="ts", price="value", order="event_id")
    cut = F.to_timestamp(F.lit("2024-01-16 12:34:00"))
    ev.where(F.col("ts") >= cut).repartition(4).write.parquet(str(tmp_path / "in"))
    own = stateful.state_session(spark)
    seed = stateful.partial_bars(ev.where(F.col("ts") < cut), **names)
    seed.write.parquet(str(tmp_path / "seed"))
    table = bar_table(spark, tmp_path / "table")
    table.merge(spark.read.parquet(str(tmp_path / "seed")).select("ticker", "datetime", "open", "high", "low", "close", "volume"), -1)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stateful.ROCKS
    table.order = ["volume"]
    for _ in range(2):  # the second run finds all batches done
        ticks = live.read_files(own, str(tmp_path / "in"), ev.schema, files_per_trigger=1)
        made = stateful.seeded_bars(ticks, own.read.parquet(str(tmp_path / "seed")), **names)
        query = made.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(table.merge).start()
        query.awaitTermination()
    assert len(table.ledger()) == 5
    want = bars(ev, "hour", ticker="event_type", ts="ts", price="value", order=["ts", "event_id"])
    rows = lambda df: sorted(map(tuple, df.select("ticker", "datetime", "open", "high", "low", "close", "volume").collect()))
    assert rows(table.read()) == rows(want)


def test_books_held_until_dropped(spark, tmp_path):
    """A code that is taken off is not repeated any more, and its state is gone."""
    own = stateful.state_session(spark)
    side = "array<struct<price: double, size: double>>"
    book, drop = f"code string, ts timestamp, bids {side}, asks {side}", "code string, ts timestamp"
    (tmp_path / "books").mkdir()
    (tmp_path / "drops").mkdir()
    put = lambda kind, n, df: df.coalesce(1).write.parquet(str(tmp_path / kind / f"n={n}"))
    at = lambda code, second: spark.sql(f"select '{code}' code, timestamp '2024-01-01 10:00:0{second}' ts, array(named_struct('price', {second}.0D, 'size', 2.0D)) bids, array() asks").select("code", "ts", "bids", F.col("asks").cast(side).alias("asks"))
    read = lambda kind, schema: own.readStream.schema(schema).parquet(str(tmp_path / kind / "*"))
    put("books", 0, at("A", 1).unionByName(at("B", 1)).unionByName(at("A", 3)).unionByName(at("A", 2)))
    held = stateful.hold_books(read("books", book), read("drops", drop), every="500 milliseconds")
    seen: list[tuple[int, str, float, bool]] = []
    query = held.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="300 milliseconds").foreachBatch(lambda df, i: seen.extend((i, r.code, r.bids[0].price, r.repeated) for r in df.collect())).start()
    state = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else 0

    def until(done):
        for _ in range(120):
            time.sleep(0.5)
            if done():
                return
        raise AssertionError(f"not within a minute: {seen[-5:]}")

    try:
        until(lambda: {(c, p) for _, c, p, again in seen if again} >= {("A", 3.0), ("B", 1.0)})
        full = state()
        put("drops", 0, spark.sql("select 'A' code, timestamp '2024-01-01 10:00:05' ts"))
        until(lambda: seen[-1][1] == "B" and sum(1 for s in seen[-4:] if s[1] == "B") == 4)
        assert state() < full
        put("books", 1, at("A", 4).unionByName(at("B", 6)))  # a late book of a dropped code is no news for those who dropped it
        until(lambda: ("B", 6.0, True) in {s[1:] for s in seen})
    finally:
        query.stop()
    assert ("A", 3.0, False) in {s[1:] for s in seen} and ("A", 2.0, False) not in {s[1:] for s in seen}


class Handle:
    """State of one code, that counts the messages to it."""

    def __init__(self):
        self.value, self.timers, self.sent = None, [], 0

    def getValueState(self, name, schema, ttl):
        return self

    def _sent(self, answer=None):
        self.sent += 1
        return answer

    def exists(self):
        return self._sent(self.value is not None)

    def get(self):
        return self._sent(self.value)

    def update(self, value):
        self.value = self._sent(value)

    def clear(self):
        self.value = self._sent()

    def listTimers(self):
        return self._sent(iter(list(self.timers)))

    def registerTimer(self, at):
        self._sent(self.timers.append(at))

    def deleteTimer(self, at):
        self._sent(self.timers.remove(at))

    def getCurrentProcessingTimeInMs(self):
        return 5000


def test_a_new_book_needs_few_messages(monkeypatch):
    """Rows are told apart without parsing them, and the state of a code that comes for the first time hears three messages, whatever the number of rows."""
    row, parsed, loads = Row("code", "at", "book", "dropped"), [], json.loads
    monkeypatch.setattr(json, "loads", lambda text: parsed.append(text) or loads(text))
    book = lambda at, price: row("A", at, json.dumps({"bids": [{"price": price, "size": "NaN"}]}), False)

    def given(handle, *rows, ttl=None):
        books = stateful._Books(1000, ttl)
        books.init(handle)
        return [(r.ts.timestamp(), r.bids[0].price) for r in books.handleInputRows(("A",), iter(rows), handle)]

    new = Handle()
    assert given(new, *(book(i * 10**6, i + 1.0) for i in range(50)), book(10**6, 99.0)) == [(49.0, 50.0)]
    assert new.sent == 3 and len(parsed) == 1 and new.timers == [6000]
    assert given(new, book(48 * 10**6, 1.0)) == [] and given(new, book(50 * 10**6, 7.0), row("A", 49 * 10**6, None, True)) == [(50.0, 7.0)] and new.timers == [6000]
    assert given(new, row("A", 60 * 10**6, None, True), book(55 * 10**6, 8.0)) == [] and new.value is None and new.timers == []
    ended = Handle()
    ended.timers = [5500]  # the book of this timer was ended by its ttl
    assert given(ended, book(10**6, 2.0), ttl=60_000) == [(1.0, 2.0)] and ended.timers == [6000]


def test_books_without_a_time(spark, tmp_path):
    """A pushed book that did not parse does not end the stream; numbers that are not finite, empty and missing sides stay what they are."""
    own = stateful.state_session(spark)
    side = "array<struct<price: double, size: double>>"
    level = lambda p: f"array(named_struct('price', double('{p}'), 'size', 0.1D))"
    at = "timestamp '2024-01-01 10:00:00.123456'"
    spark.sql(f"select 'A' code, cast(null as timestamp) ts, cast(null as {side}) bids, cast(null as {side}) asks union all select 'B', null, null, null union all select 'B', {at}, {level('inf')}, null union all select 'C', {at}, {level('nan')}, array()").write.parquet(str(tmp_path / "books"))
    spark.sql(f"select 'C' code, {at} - interval 1 second ts union all select 'D', null").write.parquet(str(tmp_path / "drops"))
    read = lambda kind, schema: own.readStream.schema(schema).parquet(str(tmp_path / kind))
    held = stateful.hold_books(read("books", f"code string, ts timestamp, bids {side}, asks {side}"), read("drops", "code string, ts timestamp"), every="1 hour")
    seen = []
    held.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).foreachBatch(lambda df, i: seen.extend(df.selectExpr("code", "unix_micros(ts) at", "bids", "asks").collect())).start().awaitTermination()
    assert sorted((r.code, r.at, str(r.bids[0].price), r.bids[0].size, r.asks) for r in seen) == [("B", 1704103200123456, "inf", 0.1, []), ("C", 1704103200123456, "nan", 0.1, [])]

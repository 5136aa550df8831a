import json

from pyspark.sql import functions as F

from quillspark.operators.bars import bars
from quillspark.sources.rest import BarSource
from quillspark.streaming import live

SF = "/root/testdata/sf0.001"
BAR = "ticker string, datetime timestamp, close double"


def test_stream_is_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    made = live.stream_bars(live.read_files(spark, str(tmp_path / "in"), ev.schema, files_per_trigger=1), ticker="event_type", ts="ts", price="value", order="event_id", late="90 days")
    made.writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start().awaitTermination()
    want = bars(ev, "hour", ticker="event_type", ts="ts", price="value", order=["ts", "event_id"])
    rows = lambda df: sorted(map(tuple, df.select("ticker", "datetime", "open", "high", "low", "close", "volume").collect()))
    assert rows(spark.table("bars")) == rows(want)


def test_flushes_and_upserts(spark, tmp_path):
    df = spark.sql("select 'A' ticker, timestamp '2024-01-01 10:00:00' datetime, 1.0D close union all select 'A', timestamp '2024-01-01 10:00:00', 1.0D union all select 'B', timestamp '2024-01-02 10:00:00', 2.0D")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.unique_bars(live.read_files(spark, str(tmp_path / "in"), df.schema)).withColumn("date", F.to_date("datetime"))
    live.write_flushes(stream, str(tmp_path / "out"), str(tmp_path / "log"), every=None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    held = {}

    def save(table, batch_id):
        table.write.mode("overwrite").parquet(str(tmp_path / f"t{len(held)}"))
        held["now"], held[len(held)] = spark.read.parquet(str(tmp_path / f"t{len(held)}")), 1

    apply = live.upsert_batches(lambda: held.get("now"), save, ["ticker", "datetime"], ["close"])
    for _ in range(2):
        apply(df, 0)
    assert held["now"].count() == 2
    assert json.loads(live.publish(df).first()["value"])["ticker"] == "A"
    assert live.subscriptions(df, spark.sql("select 'A' ticker")).count() == 2
    seen = []
    live.run_strategy(lambda b, p: b.limit(1), lambda: df, lambda: df, lambda d, i: seen.append(d.count()))(df, 0)
    assert seen == [1]


def test_rest_source(spark, tmp_path):
    bar = {"t": 60000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}
    (tmp_path / "BF.A.json").write_text(json.dumps({"results": [bar], "next_url": str(tmp_path / "page2")}))
    (tmp_path / "page2.json").write_text(json.dumps({"results": [bar | {"t": 120000}]}))
    spark.dataSource.register(BarSource)
    reader = spark.read.format("rest_bars").option("base", str(tmp_path)).option("transport", "quillspark.sources.rest:file_transport")
    got = reader.option("tickers", "BF-A,GONE").load().orderBy("datetime").collect()
    assert [(r["ticker"], r["datetime"].minute, r["close"]) for r in got] == [("BF-A", 1, 1.5), ("BF-A", 2, 1.5)]
    assert reader.option("tickers", "").load().count() == 0


def failing_transport(url, params):
    return (500, {}) if "BAD" in url else (403, {}) if "DENIED" in url else (200, {"results": [{"t": 0, "o": 1, "h": 1, "l": 1, "c": 1, "v": 1}]}) if "GOOD" in url else (404, {})


def test_rest_errors_are_rows(spark):
    spark.dataSource.register(BarSource)
    reader = spark.read.format("rest_bars").option("base", "x").option("transport", "tests.test_streaming:failing_transport").option("backoff", "0").option("retries", "2").option("parallel", "2")
    got = reader.option("tickers", "GOOD,BAD,DENIED,GONE").option("errors", "rows").load().collect()
    assert sorted((r["ticker"], r["status"], r["datetime"] is None, bool(r["error"])) for r in got) == [("BAD", "error", True, True), ("DENIED", "error", True, True), ("GONE", "not_found", True, False), ("GOOD", "done", False, False)]


def paged_transport(url, params):
    """Page 1 is good; page 2 is refused, or is there for those who bring their key."""
    if params.get("key") != "k1":
        return 403, {}
    one = {"results": [{"t": 0, "o": 1, "h": 1, "l": 1, "c": 1, "v": 1}]}
    if url.endswith("page2"):
        return (403, {}) if "HALF" in url else (200, one)
    return 200, one | {"next_url": url + "-page2"}


def test_a_ticker_is_whole_or_not_there(spark):
    spark.dataSource.register(BarSource)
    reader = spark.read.format("rest_bars").option("base", "x").option("transport", "tests.test_streaming:paged_transport").option("always", '{"key": "k1"}')
    got = reader.option("tickers", "GOOD,HALF").option("errors", "rows").load().collect()
    assert sorted((r["ticker"], r["status"], r["datetime"] is None) for r in got) == [("GOOD", "done", False)] * 2 + [("HALF", "error", True)]


CALLS: list[int] = []


def batch_transport(url, params):
    """Refuses a batch with a bad symbol, by name unless the symbol is mute; answers in pages."""
    symbols = params["symbols"].split(",")
    CALLS.append(len(symbols))
    bad = next((s for s in symbols if s.startswith("BAD")), None)
    if bad:
        return 400, {"message": f"invalid symbol: {bad}"}
    if any(s.startswith("MUTE") for s in symbols):
        return 422, {"message": "unprocessable"}
    bar = {"t": 60000, "o": 1, "h": 1, "l": 1, "c": 1, "v": 1}
    if url == "pages" and "page_token" not in params:
        return 200, {"bars": {s: [bar] for s in symbols}, "next_page_token": "p2"}
    return 200, {"bars": {s: [bar] for s in symbols if s != "EMPTY"}}


def batched(tickers, **options):
    CALLS.clear()
    reader = BarSource({"tickers": ",".join(tickers), "transport": "tests.test_streaming:batch_transport", "base": "x", "errors": "rows", "batch": "100", "backoff": "0"} | options).reader(None)
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_batches_drop_bad_symbols(spark):
    good = [f"T{i}" for i in range(97)]
    rows = batched(good[:50] + ["BAD1", "BAD2"] + good[50:] + ["BAD3"])
    assert sorted(r[0] for r in rows if r[-2] == "done") == sorted(good)
    assert sorted((r[0], r[1]) for r in rows if r[-2] == "invalid") == [("BAD1", None), ("BAD2", None), ("BAD3", None)]
    assert len(rows) == 100 and len(CALLS) <= 5


def test_batches_without_names(spark):
    rows = batched([f"T{i}" for i in range(30)] + ["MUTE", "EMPTY", "BF-A"], parallel="1")
    assert {r[0]: r[-2] for r in rows if r[-2] != "done"} == {"MUTE": "invalid", "EMPTY": "not_found"}
    assert sum(r[-2] == "done" for r in rows) == 31 and "BF-A" in {r[0] for r in rows} and len(CALLS) < 20
    assert len(batched(["A", "B"], base="pages")) == 4
    spark.dataSource.register(BarSource)
    reader = spark.read.format("rest_bars").option("base", "x").option("transport", "tests.test_streaming:batch_transport").option("batch", "10").option("errors", "rows")
    got = reader.option("tickers", ",".join(f"T{i}" for i in range(35)) + ",BAD").load()
    assert {(r["status"], r["count"]) for r in got.groupBy("status").count().collect()} == {("done", 35), ("invalid", 1)}

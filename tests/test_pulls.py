"""Backfills that go on where they ended, incremental histories, reads behind a staleness rule, the report."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.operators import health, report
from quillspark.sources import pulls
from quillspark.plans import catalog, feeds
from quillspark.sources.rest import BarReader, BarSource, PageReader, PageSource, write_names
from quillspark.sources.versions import VersionedTable

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def tables(spark, root):
    bars = VersionedTable(spark, f"{root}/bars", ["ticker", "datetime"], ["close"], F.to_date("datetime"))
    return bars, VersionedTable(spark, f"{root}/ledger", ["ticker"], ["fetched_at"])


def batches(url, params):
    symbols = params["symbols"].split(",")
    bad = next((s for s in symbols if s.startswith("BAD")), None)
    if bad:
        return 400, {"message": f"invalid symbol: {bad}"}
    if any(s.startswith("DOWN") for s in symbols) and url == "down":
        return 503, {}
    return 200, {"bars": {s: [{"t": 86_400_000 * d, "o": 1, "h": 1, "l": 1, "c": d, "v": 1} for d in (1, 2)] for s in symbols if s != "NONE"}}


def status_of(ledger):
    return {r.ticker: (r.status, r.n_bars) for r in ledger.read().collect()}


def test_backfill_goes_on(spark, tmp_path):
    bars, ledger = tables(spark, tmp_path)
    tickers = spark.createDataFrame([(t,) for t in ["A", "B", "BAD1", "BF-A", "DOWN1", "NONE", "Z", "Z"]], "ticker string")
    options = dict(base="down", transport="tests.test_pulls:batches", batch="2", retries="1", backoff="0", parallel="2")
    assert pulls.backfill(tickers, bars, ledger, pulls.rest_read(spark, **options), now(), every=2) == 4
    assert status_of(ledger) == {"A": ("done", 2), "B": ("done", 2), "BAD1": ("invalid", 0), "BF-A": ("done", 2), "DOWN1": ("error", 0), "NONE": ("error", 0), "Z": ("done", 2)}
    assert bars.read().count() == 8
    asked = []

    def up(chunk):
        asked.extend(r[0] for r in chunk.collect())
        return pulls.rest_read(spark, **(options | {"base": "up"}))(chunk)

    assert pulls.backfill(tickers, bars, ledger, up, now(), every=10) == 1
    assert sorted(asked) == ["BAD1", "DOWN1", "NONE"]  # done tickers are not asked for again
    assert status_of(ledger)["DOWN1"] == ("done", 2) and status_of(ledger)["NONE"] == ("not_found", 0) and bars.read().count() == 10


def test_backfill_killed_between_bars_and_ledger(spark, tmp_path):
    bars, ledger = tables(spark, tmp_path)
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    read = pulls.rest_read(spark, base="up", transport="tests.test_pulls:batches", batch="5", backoff="0")
    real, ledger.merge = ledger.merge, lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        pulls.backfill(tickers, bars, ledger, read, now())
    assert ledger.read() is None and bars.read().count() == 4
    ledger.merge = real
    pulls.backfill(tickers, bars, ledger, read, now())
    assert status_of(ledger) == {"A": ("done", 2), "B": ("done", 2)} and bars.read().count() == 4


def test_backfill_in_growing_rounds(spark, tmp_path):
    """Seven chunks in three rounds, each ticker asked for once; a call that ends in the third goes on from there."""
    bars, ledger = tables(spark, tmp_path)
    tickers = spark.createDataFrame([(f"T{i:02d}",) for i in range(14)], "ticker string")
    one, asked = pulls.rest_read(spark, base="up", transport="tests.test_pulls:batches", batch="2", backoff="0"), []

    def read(chunk):
        asked.append(sorted(r[0] for r in chunk.collect()))
        if len(asked) == 3:
            raise KeyboardInterrupt
        return one(chunk)

    with pytest.raises(KeyboardInterrupt):
        pulls.backfill(tickers, bars, ledger, read, now(), every=2, growth=2)
    assert [len(a) for a in asked] == [2, 4, 8] and len(status_of(ledger)) == 6 and bars.read().count() == 12
    assert pulls.backfill(tickers, bars, ledger, read, now(), every=2, growth=2) == 4
    assert [len(a) for a in asked[3:]] == [2, 4, 2] and sorted(sum(asked[3:], [])) == asked[2]
    assert status_of(ledger) == {f"T{i:02d}": ("done", 2) for i in range(14)} and bars.read().count() == 28


def test_history(spark, tmp_path):
    bars, _ = tables(spark, tmp_path)
    asked = []

    def read_from(tickers, start):
        names = sorted(r[0] for r in tickers.collect())
        asked.append((names, start and start.isoformat()))
        days = [d for d in ("2024-01-01", "2024-01-02", "2024-01-03") if start is None or d >= start.date().isoformat()]
        rows = [(t, f"{d} 00:00:00", 1.0, 1.0, 1.0, float(len(asked)), 1.0) for t in names for d in days if not (t == "B" and d == "2024-01-03" and len(asked) < 3)]
        return spark.createDataFrame(rows, "ticker string, datetime string, open double, high double, low double, close double, volume double").withColumn("datetime", F.to_timestamp("datetime"))

    pulls.pull_history(spark.createDataFrame([("A",), ("B",)], "ticker string"), bars, read_from)
    pulls.pull_history(spark.createDataFrame([("B",), ("C",), ("A",)], "ticker string"), bars, read_from)
    assert asked == [(["A", "B"], None), (["C"], None), (["A", "B"], "2024-01-02T00:00:00")]
    assert {(r.ticker, r.n) for r in bars.read().groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {("A", 3), ("B", 3), ("C", 3)}
    assert pulls.pull_history(spark.createDataFrame([], "ticker string"), bars, lambda t, s: bars.read().limit(0)) is None


def test_routes(spark):
    rows = spark.createDataFrame([("PLTR", "EQUITY"), ("ETHUSDT", "CRYPTOCURRENCY"), ("GONE", None), ("NIL", "")], "ticker string, quote_type string")
    assert sorted(tuple(r) for r in pulls.routes(rows).collect()) == [("ETHUSDT", "cryptos", False, True), ("PLTR", "equities", True, True)]


CALLS = []


def pages(url, params):
    with open(url, "a") as f:
        f.write("x\n")
    ids = params["ids"].split(",")
    return (200, [{"id": i, "market_cap": len(i)} for i in ids if i != "unknown"]) if "broken" not in ids else (404, [])


def test_read_through(spark, tmp_path):
    """A second read within the day makes no call; the next day does."""
    spark.dataSource.register(PageSource)
    calls = tmp_path / "calls"
    table = VersionedTable(spark, str(tmp_path / "coins"), ["id"], ["raw"])
    ids = [f"coin{i}" for i in range(7)] + ["unknown"]
    fetch = lambda: spark.read.format("rest_pages").options(base=str(calls), transport="tests.test_pulls:pages", ids=",".join(ids), per_page="3", backoff="0").load()
    for at, n in (("2024-01-01 10:00:00", 3), ("2024-01-01 23:59:00", 3), ("2024-01-02 00:01:00", 6)):
        got = pulls.read_through(table, fetch, at, freq="daily")
        assert len(calls.read_text().split()) == n and got.count() == 8
        assert {r.id for r in got.where("raw is null").collect()} == {"unknown"} and json.loads(got.where("id = 'coin1'").first().raw)["market_cap"] == 5
    pulls.read_through(table, fetch, "2024-01-02 00:02:00", freq="daily", force=True)
    assert len(calls.read_text().split()) == 9
    bad = spark.read.format("rest_pages").options(base=str(calls), transport="tests.test_pulls:pages", ids="a,b,broken", per_page="2").load()
    assert {r.id: r.error for r in bad.collect()} == {"a": None, "b": None, "broken": "404"}


def test_names_in_files(spark, tmp_path):
    """Names that tasks read from files: the same rows as a list in an option, and no name in what the driver plans."""
    spark.dataSource.register(PageSource)
    spark.dataSource.register(BarSource)
    ids = [f"coin{i}" for i in range(40)] + ["unknown"]
    at = write_names(spark.createDataFrame([(i,) for i in ids], "id string"), str(tmp_path / "names"), 3)
    shared = dict(transport="tests.test_pulls:pages", base=str(tmp_path / "calls"), per_page="4")
    rows = lambda **o: sorted(map(tuple, spark.read.format("rest_pages").options(**shared, **o).load().collect()), key=str)
    assert rows(names_at=at) == rows(ids=",".join(ids)) and len(rows(names_at=f"file://{at}")) == 41
    reader = PageReader(dict(names_at=at, **shared))
    assert 1 < len(reader.partitions()) <= 3 and "coin" not in str([p.value for p in reader.partitions()])
    bars = spark.read.format("rest_bars").options(transport="tests.test_pulls:batches", base="up", batch="5", errors="rows", names_at=at).load()
    assert sorted((r.ticker, r.n) for r in bars.groupBy("ticker").agg(F.count("datetime").alias("n")).collect()) == sorted((i, 2) for i in ids)


def test_pauses_of_all_partitions(spark):
    """The share of a call is settled once, not by dealing all names out again for each request."""
    reader = BarReader(dict(tickers=",".join("abcd"), per_minute="60", parallel="4", transport="tests.test_pulls:batches", base="up"))
    assert reader.pause == 4
    reader.deal = None
    assert len(reader.partitions()) == 4 and PageReader(dict(ids="a,b,c", per_page="1", per_minute="60")).pause == 3


def test_services_read_their_own_rows(spark, tmp_path, monkeypatch):
    """A request reads the row groups of its keys, not the table."""
    rows = spark.range(200_000).select((F.col("id") % 2500).alias("user_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    held, read = feeds._shelved(rows, "user_id", str(tmp_path / "bars")), []
    real = feeds._group.__wrapped__
    monkeypatch.setattr(feeds, "_group", lambda *a: read.append(real(*a)) or read[-1])
    status, data = feeds.bar_service(f"{held}/1700", {})
    assert status == 200 and len(data["results"]) == 80 and "next_url" not in data and [r["t"] for r in data["results"]] == sorted(r["t"] for r in data["results"])
    assert 80 <= sum(t.num_rows for t in read) <= 40_000
    assert {k: len(v) for k, v in feeds.bar_service(held, {"symbols": "999,1000,2499,2500"})[1]["bars"].items()} == {"999": 80, "1000": 80, "2499": 80}


def test_failed_pages_end_the_read(spark, tmp_path):
    spark.dataSource.register(PageSource)
    read = lambda ids: spark.read.format("rest_pages").options(base=str(tmp_path / "calls"), transport="tests.test_pulls:pages", ids=ids, per_page="2", errors="raise").load()
    assert {r.id: r.raw is None for r in read("a,b,unknown").collect()} == {"a": False, "b": False, "unknown": True}
    with pytest.raises(PySparkException, match="broken to c: 404"):
        read("a,b,broken,c").collect()


@pytest.mark.parametrize("fault", ["garbled", "lost"])
@pytest.mark.parametrize("name", ["object_metadata", "weekly_fundamentals"])
def test_faults_of_a_service_are_no_results(spark, monkeypatch, name, fault):
    """Objects that a service cannot read, or has lost, end the query and are not taken for unknown ones."""
    shelved = feeds._shelved

    def faulty(rows, key, folder):
        if fault == "garbled":
            for path in Path(shelved(rows, key, folder)).rglob("part-*.parquet"):
                path.write_bytes(b"PAR0" * 100)
        return folder

    monkeypatch.setattr(feeds, "_shelved", faulty)
    with pytest.raises(PySparkException, match="not in" if fault == "lost" else "[Pp]arquet"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_report(spark):
    tickers = spark.createDataFrame([(f"<T{i}>", "cryptos") for i in range(30)] + [("E", "equities")], "ticker string, asset_class string")
    days = spark.sql("select a asset_class, date '2024-01-01' date, 10 expected_minutes from values ('cryptos'), ('equities') t(a)")
    counts = spark.sql("select 'E' ticker, date '2024-01-01' date, 9L n")
    page = report.html_report(health.gap_report(tickers, days, counts), "2024-01-02", worst=5, dead=10)
    assert page.count("Only the first 10 are shown") == 1 and "&lt;T0&gt;" in page and "<T0>" not in page and "Worst coverage: equities" in page

"""Registered queries over streams, and the same in SQL over the finished tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.operators import decisions, panels, screening, upsert
from quillspark.operators.bars import bars
from quillspark.plans import views
from quillspark.plans.catalog import DAILY, HOURLY, POLLED, query
from quillspark.plans.records import DAYS, captures
from quillspark.sources import calendars, files, pulls
from quillspark.sources.rest import BarSource, PageSource, write_names
from quillspark.sources.shared import shared_folder
from quillspark.sources.versions import BucketedTable, VersionedTable
from quillspark.streaming import live, push, stateful

EVENTS = dict(ticker="event_type", ts="ts", price="value", order="event_id")


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of their files."""
    schema = views.events(spark, sf).schema
    return live.read_files(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _bars_of(table: VersionedTable) -> DataFrame:
    return table.read().withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(HOURLY)
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a file stream that runs until it has read all; each batch's changes are a version of a table, by day."""
    out = shared_folder(spark, "stream")
    table = VersionedTable(spark, f"{out}/bars", ["ticker", "datetime"], ["volume"], F.to_date("datetime"))
    # update mode: a batch brings the bars that it changed; the watermark ends their state
    made = live.stream_bars(_ticks(spark, sf), **EVENTS)
    made.writeStream.outputMode("update").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(table.merge).start().awaitTermination()
    table.vacuum()
    return _bars_of(table)


@query(HOURLY)
def stream_after_history(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the first half of the events' time, computed at once, are the initial state of a stream over the second half; the half falls within an hour."""
    out, own = shared_folder(spark, "stream"), stateful.state_session(spark)
    ev = views.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = ev.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long")).alias("cut"))
    before = ev.join(F.broadcast(cut)).where("ts < cut")  # one row
    stateful.partial_bars(before, **EVENTS).write.parquet(f"{out}/seed")
    cut.write.parquet(f"{out}/cut")
    table = VersionedTable(spark, f"{out}/bars", ["ticker", "datetime"], ["volume"], F.to_date("datetime"))
    table.merge(spark.read.parquet(f"{out}/seed").select("ticker", "datetime", "open", "high", "low", "close", "volume"), -1)
    after = _ticks(own, sf).join(F.broadcast(own.read.parquet(f"{out}/cut"))).where("ts >= cut")
    made = stateful.seeded_bars(after, own.read.parquet(f"{out}/seed"), **EVENTS)
    made.writeStream.outputMode("update").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(table.merge).start().awaitTermination()
    table.vacuum()
    return _bars_of(table)


@query("SELECT event_id, event_type, ts, value, CAST(ts AS DATE) AS date FROM events")
def flushed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events through the file sink, in a folder for each date, read back as one table."""
    out = shared_folder(spark, "stream")
    rows = _ticks(spark, sf).select("event_id", "event_type", "ts", "value", F.to_date("ts").alias("date"))
    live.write_flushes(rows, f"{out}/flushes", f"{out}/log", every=None).awaitTermination()
    return spark.read.parquet(f"{out}/flushes").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "date")


# Pulls


@query(f"""
    WITH bad AS (SELECT CAST(user_id AS VARCHAR) AS ticker FROM events GROUP BY user_id HAVING min(value) < 0.5),
    d AS (SELECT ticker, count(*) AS n_bars, min(datetime) AS first, max(datetime) AS last FROM ({DAILY}) GROUP BY 1)
    SELECT ticker, CASE WHEN b THEN 'error' ELSE 'done' END AS status, CASE WHEN b THEN 0 ELSE n_bars END AS n_bars, CASE WHEN NOT b THEN first END AS first, CASE WHEN NOT b THEN last END AS last, CASE WHEN b THEN 'timeout' END AS error
    FROM (SELECT *, ticker IN (FROM bad) AS b FROM d)
""")
def backfill_run(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill of every user's daily bars in two calls: a service that is down for some users, and the ledger after the second call."""
    out = shared_folder(spark, "backfill")
    ev = views.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ticker", F.col("user_id").cast("string"))
    held = VersionedTable(spark, f"{out}/bars", ["ticker", "datetime"], ["close"], F.to_date("datetime"))
    ledger = VersionedTable(spark, f"{out}/ledger", ["ticker"], ["fetched_at"])

    def read(tickers: DataFrame) -> DataFrame:
        own = ev.join(tickers, "ticker", "left_semi")
        down = own.groupBy("ticker").agg(F.min("value").alias("least")).where("least < 0.5").select("ticker")
        made = bars(own.join(down, "ticker", "left_anti"), "day", ticker="ticker", ts="ts", price="value", order=["ts", "event_id"])
        return made.select(*pulls.BARS, F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(down.withColumns({"status": F.lit("error"), "error": F.lit("timeout")}), allowMissingColumns=True)

    for _ in range(2):
        pulls.backfill(ev.select("ticker"), held, ledger, read, F.lit("2024-02-01").cast("timestamp"), every=1000, growth=2)
    return ledger.read().select("ticker", "status", "n_bars", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "error")


@query("SELECT CAST(d AS DATE) AS date, CAST(1440 AS BIGINT) AS minutes FROM (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS d)")
def every_day(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar of a market that never closes, over the events' days, with the minutes of each day."""
    first, last = views.events(spark, sf).agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = calendars.always_open(spark, first, last)
    return days.select("date", numbers.minutes_between(F.col("market_open"), F.col("market_close")).cast("long").alias("minutes"))


@query("SELECT CAST(user_id AS VARCHAR) AS name, datediff('day', CAST(max(ts) AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) >= 7 AS stale FROM events GROUP BY 1 UNION ALL SELECT 'never', true")
def stale_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users as tables last written by their last event, and one never written, against a weekly rule."""
    ev = views.events(spark, sf)
    control = ev.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max("ts").alias("written_at"))
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    return files.stale(control, control.select("name").unionByName(spark.sql("select 'never' name")), now, freq="weekly")


@query("SELECT user_id, CASE WHEN (SELECT max(ts) FROM events) - max(ts) > INTERVAL 24 HOUR THEN max(ts) ELSE (SELECT max(ts) FROM events) - INTERVAL 24 HOUR END AS start FROM events GROUP BY 1")
def pull_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Where each user's next pull would start."""
    ev = views.events(spark, sf)
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    return ev.groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", numbers.pull_starts(F.col("last"), now).alias("start"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate = (SELECT max(o_orderdate) FROM orders) THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders")
def bucketed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as history in buckets of their keys, then the last day's again with another price: only their buckets are rewritten, and history is not shuffled."""
    out, orders = shared_folder(spark, "buckets"), files.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    held = BucketedTable(spark, f"{out}/orders", ["o_orderkey"], ["o_orderdate"], 16)
    held.merge(orders, "history")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    held.merge(orders.join(F.broadcast(last)).where("o_orderdate = last").drop("last").withColumn("o_totalprice", -F.col("o_totalprice")), "day")  # one row is broadcast
    held.vacuum()
    return held.read().drop("o_orderdate")


# Services that read the test tables, as a broker's or a vendor's would be read


class EventLog:
    """The events as the numbered messages of a push service (see ``push``): a book and a bar for each event, of which a task reads its own range."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def first(self) -> int:
        return 0

    def end(self) -> int:
        return 2 * pq.read_metadata(self.path).num_rows

    def fetch(self, start: int, end: int) -> Iterator[tuple[int, str, str, str]]:
        at, file = 0, pq.ParquetFile(self.path)
        for group in range(file.num_row_groups):
            n = 2 * file.metadata.row_group(group).num_rows
            if at < end and at + n > start:
                first = at // 2
                for batch in file.iter_batches(1 << 14, [group], ["event_id", "ts", "user_id", "event_type", "value"]):
                    low, high = max(start // 2 - first, 0), min((end + 1) // 2 - first, batch.num_rows)
                    for i, r in enumerate(batch.slice(low, high - low).to_pylist() if low < high else [], first + low):
                        price, when = r["value"], r["ts"].isoformat(" ")
                        book = {"ts": when, "bids": [{"price": price, "size": r["event_id"]}], "asks": [{"price": price + 1, "size": 1}]}
                        bar = {"datetime": when, "open": price, "high": price, "low": price, "close": price, "volume": r["event_id"]}
                        both = (2 * i, str(r["user_id"]), "book", json.dumps(book)), (2 * i + 1, r["event_type"], "bar", json.dumps(bar))
                        yield from (m for m in both if start <= m[0] < end)
                    first += batch.num_rows
                    if 2 * first >= end:
                        break
            at += n

    def acknowledge(self, end: int) -> None:
        """The table keeps all its messages."""


def _register(spark: SparkSession, source: type) -> None:
    """Register a source in this session, whichever is the active one: Spark looks for others of its name in the active one."""
    sessions, active = spark._jvm.org.apache.spark.sql.classic.SparkSession, SparkSession.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        spark.dataSource.register(source)
    finally:
        if active is not None:
            sessions.setActiveSession(active._jsparkSession)


def _pushes(spark: SparkSession, sf: str) -> DataFrame:
    _register(spark, push.PushSource)
    # a task decodes the row group of its range from the start, and its shuffle writes a block for each partition: few large ranges
    return spark.readStream.format("push_log").option("transport", f"{__name__}:EventLog").option("path", f"{sf}/events.parquet").option("per_partition", "100000").load()


def _drained(writer) -> None:
    """A stream until it has read what there is now."""
    running = writer.start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


@query("SELECT event_type AS ticker, ts AS datetime, value AS close, CAST(event_id AS DOUBLE) AS volume FROM events")
def published_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that a service pushes, published as messages by ticker, and the messages of all batches read back."""
    out = shared_folder(spark, "messages")
    pushes = _pushes(spark, sf)
    _register(spark, push.MessageSink)
    messages = live.publish(push.pushed_bars(pushes).drop("number"))
    _drained(messages.writeStream.format("message_log").option("folder", f"{out}/log").option("checkpointLocation", f"{out}/state"))
    bar = F.from_json("value", "datetime timestamp, close double, volume double")
    return push.read_messages(spark, f"{out}/log").select(F.col("key").alias("ticker"), bar.alias("b")).select("ticker", F.col("b.datetime").cast("timestamp_ntz").alias("datetime"), "b.close", "b.volume")


@query("""SELECT CAST(user_id AS VARCHAR) AS code, max(ts) AS ts, max_by(value, ts) AS bid, CAST(max_by(event_id, ts) AS DOUBLE) AS size FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) % 2 = 1) GROUP BY 1""")
def watched_books(spark: SparkSession, sf: str) -> DataFrame:
    """The last pushed book of each code that is still on the watchlist: codes taken off (those with an odd number of events) lose their state and what was held of them."""
    out, own = shared_folder(spark, "books"), stateful.state_session(spark)
    books = push.pushed_books(_pushes(own, sf))
    ev = views.events(spark, sf).groupBy(F.col("user_id").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ts").cast("timestamp")).alias("ts"))
    ev.where("n % 2 = 1").select("code", "ts").write.parquet(f"{out}/drops")
    drops = live.read_files(own, f"{out}/drops", "code string, ts timestamp")
    held = VersionedTable(spark, f"{out}/books", ["code"], ["ts"])
    made = stateful.hold_books(books, drops, every="1 hour").where("not repeated")
    # one batch of what there is now: a stream with timers never runs out of batches
    made.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(once=True).foreachBatch(held.merge).start().awaitTermination()
    left = held.read().join(spark.read.parquet(f"{out}/drops"), "code", "left_anti")
    held.vacuum()
    level = F.get("bids", F.lit(0))
    return left.select("code", F.col("ts").cast("timestamp_ntz").alias("ts"), level["price"].alias("bid"), level["size"].alias("size"))


SHELF = 1000  # keys to a folder of what a service holds


def _shelved(rows: DataFrame, key: str, folder: str) -> str:
    """What a service holds, by key: a folder for each ``SHELF`` keys, sorted, in small row groups, so that a request reads about its own rows and not the table."""
    shelf = F.floor(F.col(key) / SHELF)
    rows.withColumn("shelf", shelf).repartitionByRange(key).sortWithinPartitions("shelf", key).write.partitionBy("shelf").option("parquet.block.size", 1 << 18).parquet(folder)
    return folder


@lru_cache(maxsize=64)
def _spans(folder: str, shelf: int, key: str) -> list[tuple[str, int, int, int]]:
    """(path, row group, least key, greatest key) of a shelf."""
    store, root = FileSystem.from_uri(folder)
    found = []
    for file in store.get_file_info(FileSelector(f"{root}/shelf={shelf}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            about = pq.read_metadata(file.path, filesystem=store)
            at = about.schema.names.index(key)
            ends = [about.row_group(g).column(at).statistics for g in range(about.num_row_groups)]
            found += [(file.path, g, e.min, e.max) for g, e in enumerate(ends)]
    return found


@lru_cache(maxsize=16)
def _group(folder: str, path: str, group: int) -> pa.Table:
    with FileSystem.from_uri(folder)[0].open_input_file(path) as f:
        return pq.ParquetFile(f).read_row_group(group, use_threads=False)


def _held(folder: str, key: str, wanted: list[int]) -> pa.Table | None:
    """The rows of some keys, or None. The last few row groups are kept, as requests for neighbours follow each other."""
    shelves: dict[int, list[int]] = {}
    for i in wanted:
        shelves.setdefault(i // SHELF, []).append(i)
    found = []
    for shelf, ids in shelves.items():
        for path, group, least, greatest in _spans(folder, shelf, key):
            if any(least <= i <= greatest for i in ids):
                rows = _group(folder, path, group)
                found.append(rows.filter(pc.is_in(rows[key], value_set=pa.array(ids, pa.int64()))))
    return pa.concat_tables(found) if found else None


def bar_service(url: str, params: dict) -> tuple[int, dict]:
    """Bars of users, one for each event, from the shelved events: ``url`` names them. Symbols that start with X are refused by name; a symbol alone comes in pages of 500."""
    base, _, rest = url.partition("?")
    single = "symbols" not in params
    path, symbol = base.rsplit("/", 1) if single else (base, None)
    symbols = [symbol] if single else params["symbols"].split(",")
    bad = next((s for s in symbols if s.startswith("X")), None)
    if bad:
        return 400, {"message": f"invalid symbol: {bad}"}
    held, at = _held(path, "user_id", [int(s) for s in symbols]), int(rest or 0)
    n = held.num_rows if held else 0
    found: dict[str, list] = {}
    rows = held.sort_by("ts").slice(at, 500 if single else None).to_pylist() if held else []
    for r in rows:
        t = (r["ts"] - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
        found.setdefault(str(r["user_id"]), []).append({"t": t, **dict.fromkeys("ohlc", r["value"]), "v": 1})
    if not single:
        return 200, {"bars": found}
    return 200, {"results": found.get(symbol, [])} | ({"next_url": f"{base}?{at + 500}"} if at + 500 < n else {})


def _pulled(spark: SparkSession, sf: str, **options: str) -> DataFrame:
    """What the service has of every user, and of a symbol for each user of an even number that it does not know."""
    out, ev = shared_folder(spark, "service"), views.events(spark, sf)
    users = ev.select("user_id").distinct()
    names = users.select(F.col("user_id").cast("string").alias("t")).unionByName(users.where("user_id % 20 = 0").select(F.concat(F.lit("X"), "user_id").alias("t")))
    base, tickers = _shelved(ev.select("user_id", "ts", "value"), "user_id", f"{out}/bars"), write_names(names, f"{out}/names", 8)
    _register(spark, BarSource)
    got = spark.read.format("rest_bars").options(names_at=tickers, base=base, transport=f"{__name__}:bar_service", errors="rows", **options).load()
    return got.groupBy("ticker", "status").agg(F.count("datetime").alias("n"), F.min("datetime").cast("timestamp_ntz").alias("first"), F.round(F.sum("close"), 6).alias("total"))


PULLED = """SELECT CAST(user_id AS VARCHAR) AS ticker, 'done' AS status, count(*) AS n, epoch_ms(epoch_us(min(ts)) // 1000) AS first, round(sum(value), 6) AS total FROM events GROUP BY user_id
    UNION ALL SELECT DISTINCT 'X' || user_id, 'invalid', 0, NULL, NULL FROM events WHERE user_id % 20 = 0"""


@query(PULLED)
def pulled_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred symbols a request: refused ones are taken out, and the rest is asked for again."""
    return _pulled(spark, sf, batch="100")


@query(PULLED)
def pulled_by_page(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol a request, page after page, over eight partitions."""
    return _pulled(spark, sf)


def customer_service(url: str, params: dict) -> tuple[int, list]:
    """Objects of customers by key, from the shelved table that ``url`` names; those of every fifth key it does not know. Only customers are asked for, so one that the table lacks is a fault and not an unknown id."""
    wanted = [int(i) for i in params["ids"].split(",")]
    held = _held(url, "c_custkey", wanted)
    lost = {*wanted} - {*(held["c_custkey"].to_pylist() if held else [])}
    if lost:
        raise LookupError(f"{len(lost)} customers are not in {url}, the first is {min(lost)}")
    return 200, [
        {"id": r["c_custkey"], "longName": r["c_name"] if r["c_custkey"] % 2 else "", "shortName": r["c_mktsegment"], "beta": "Infinity" if r["c_custkey"] % 3 == 0 else r["c_acctbal"], "marketCap": r["c_custkey"]}
        for r in held.to_pylist() if r["c_custkey"] % 5
    ]


def _customer_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's object, or null where the service does not know it; a request that fails ends the query."""
    _register(spark, PageSource)
    out, customers = shared_folder(spark, "service"), files.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    base = _shelved(customers, "c_custkey", f"{out}/objects")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = write_names(customers.select(F.col("c_custkey").cast("string").alias("id"), "c_custkey"), f"{out}/names", parts, "c_custkey")
    got = spark.read.format("rest_pages").options(names_at=ids, base=base, transport=f"{__name__}:customer_service", errors="raise").load()
    return got.select(F.col("id").alias("ticker"), "raw", F.lit("equities").alias("asset_class"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 > 0 THEN c_acctbal END AS beta FROM customer")
def weekly_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly fields of every customer's object, 250 ids a request; what is no finite number, or not known, is NULL."""
    return screening.fundamentals(_customer_blobs(spark, sf), "equities", "weekly")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ticker, 'equities' AS asset_class, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE c_mktsegment END AS name, CAST(c_custkey AS DOUBLE) AS market_cap
    FROM customer WHERE c_custkey % 5 > 0""")
def object_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised metadata of the same objects, those that the service knows."""
    return screening.equity_metadata(_customer_blobs(spark, sf).where("raw is not null")).select("ticker", "asset_class", "name", "market_cap")


# Tables as files, and strategies on a stream


@query(f"{DAYS} SELECT date, CAST(n % 90 AS DOUBLE) AS bearish_pct, CAST(n % 100 AS DOUBLE) AS bullish_pct FROM d WHERE date >= (SELECT date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) FROM events)")
def loaded_panels(spark: SparkSession, sf: str) -> DataFrame:
    """A history table written sorted by its key, with a batch over it, and loaded by its name from the middle day on."""
    out = shared_folder(spark, "panels")
    rows, keys = panels.tables(panels.extract(captures(spark, sf)))["panel_sentiment"]
    rows.limit(0).write.parquet(f"{out}/empty")
    upsert.write_upsert(spark, f"{out}/empty", f"{out}/panel_sentiment", rows, keys, keys)
    ts = F.col("ts").cast("timestamp")
    middle = views.events(spark, sf).agg(F.date_trunc("day", F.timestamp_micros(((F.unix_micros(F.min(ts)) + F.unix_micros(F.max(ts))) / 2).cast("long"))).cast("timestamp_ntz").alias("at")).first()["at"]
    return files.load(spark, out, "panel_sentiment", middle)


@query("SELECT upper(n_name) || 'USDT' AS symbol, upper(n_name) AS base FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def unmatched_file(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols without a coin, as a side file of JSON lines, read back."""
    out, nations = shared_folder(spark, "side"), files.table(spark, sf, "nation").select("n_nationkey", F.upper("n_name").alias("base"))
    coins = files.table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey").select(F.lower("base").alias("symbol"))
    files.write_side_file(screening.unmatched(nations.select(F.concat("base", F.lit("USDT")).alias("symbol"), "base"), coins), f"{out}/unmatched")
    return spark.read.schema("symbol string, base string").json(f"{out}/unmatched")


@query(POLLED)
def polled_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy that is asked after each batch of a stream of daily bars: what it said after the last one. Held are the users of even numbers."""
    out = shared_folder(spark, "polls")
    held = VersionedTable(spark, f"{out}/bars", ["ticker", "datetime"], ["volume"], F.to_date("datetime"))
    said = VersionedTable(spark, f"{out}/decisions", ["seq"], ["symbol"])
    positions = views.events(spark, sf).where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("symbol")).distinct()
    ask = live.run_strategy(decisions.sma_cross_strategy(3, 8), held.read, lambda: positions, said.replace)

    def poll(batch: DataFrame, batch_id: int) -> None:
        held.merge(batch.withColumn("ticker", F.col("ticker").cast("string")), batch_id)
        ask(batch, batch_id)

    made = live.stream_bars(_ticks(spark, sf), **EVENTS | {"ticker": "user_id"}, width="1 day")
    made.writeStream.outputMode("update").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(poll).start().awaitTermination()
    held.vacuum()
    return said.read()

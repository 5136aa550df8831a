"""Hand-computed examples of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers, text
from quillspark.operators import allocation, bars, decisions, health, indicators, orderbook, panels, screening, upsert
from quillspark.sources import calendars, files

DAY = dt.date(2024, 1, 1)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


SIGNALS = [("A", 1, 3.0), ("B", 2, 1.0), ("C", 3, 1.0), ("D", 4, -2.0), ("E", 5, None)]


@pytest.mark.parametrize(
    ("method", "top_k", "long_only", "want"),
    [
        ("equal", 2, True, [0.5, 0.5, 0, 0, 0]),
        ("signal", 2, True, [0.75, 0.25, 0, 0, 0]),
        ("rank", 2, True, [2 / 3, 1 / 3, 0, 0, 0]),
        ("inverse_rank", 2, True, [2 / 3, 1 / 3, 0, 0, 0]),
        ("equal", None, False, [0.25, 0.25, 0.25, -0.25, 0]),
        ("signal", None, False, [3 / 7, 1 / 7, 1 / 7, -2 / 7, 0]),
        ("rank", None, False, [0.4, 0.1, 0.2, -0.3, 0]),
        ("inverse_rank", None, False, [0.48, 0.16, 0.12, -0.24, 0]),
    ],
)
def test_allocation(spark, method, top_k, long_only, want):
    df = spark.createDataFrame([(DAY, *s) for s in SIGNALS], "ts date, asset string, asset_pos int, signal double")
    got = allocation.allocate(df, allocation.parameters(spark, method, top_k), long_only=long_only).orderBy("asset_pos").collect()
    assert [r["weight"] for r in got] == pytest.approx(want)


def test_allocation_edges(spark):
    rows = [(DAY, "A", 1, -1.0), (DAY, "B", 2, None), (DAY + dt.timedelta(1), "A", 1, float("inf")), (DAY + dt.timedelta(1), "B", 2, 1.0), (DAY + dt.timedelta(2), "A", 1, float("nan"))]
    df = spark.createDataFrame(rows, "ts date, asset string, asset_pos int, signal double")
    assert all(r["weight"] == 0 for r in allocation.allocate(df, allocation.parameters(spark, "signal", None)).collect())
    for method, k in (("x", None), ("equal", 0), ([], None), ("equal", [1, 0])):
        with pytest.raises(ValueError):
            allocation.parameters(spark, method, k)


def test_allocation_sums(spark):
    random.seed(4)
    rows = [(DAY + dt.timedelta(d), f"a{i}", i, random.choice([None, random.uniform(-3, 3)])) for d in range(20) for i in range(8)]
    df = spark.createDataFrame(rows, "ts date, asset string, asset_pos int, signal double")
    for long_only in (True, False):
        got = allocation.allocate(df, allocation.parameters(spark, list(allocation.METHODS), [None, 3]), long_only=long_only)
        sums = got.groupBy("method", "top_k", "ts").agg(F.sum(F.abs("weight")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert len(sums) == 8 * 20 and all(r["n"] == 8 and (r["s"] == 0 or abs(r["s"] - 1) < 1e-9) for r in sums)


def test_gap_report(spark):
    counts = spark.createDataFrame([("X", dt.date(2024, 1, d), n) for d, n in ((1, 400), (2, 351), (3, 350))], "ticker string, date date, n long")
    cal = spark.createDataFrame([("e", dt.date(2024, 1, d), 390) for d in (1, 2, 3, 4)], "asset_class string, date date, expected_minutes int")
    rows = health.gap_report(spark.createDataFrame([("X", "e")], "ticker string, asset_class string"), cal, counts).orderBy("date").collect()
    assert [round(r["completeness"], 4) for r in rows] == [1.0, 0.9, 0.8974, 0.0]
    assert [r["needs_refetch"] for r in rows] == [False, False, True, True]
    assert [r["is_whole_day_gap"] for r in rows] == [False, False, False, True]


def test_islands(spark):
    d = lambda i: dt.date(2024, 1, i)
    missing = spark.createDataFrame([("X", d(1)), ("X", d(2)), ("X", d(4)), ("Y", d(1)), ("Y", d(2)), ("Y", d(5))], "ticker string, date date")
    days = spark.createDataFrame([(d(i),) for i in range(1, 6)], "date date")
    got = lambda v: sorted(tuple(r) for r in health.islands(missing, v).collect())
    assert got(days) == [(d(1), d(2), "X,Y"), (d(4), d(4), "X"), (d(5), d(5), "Y")]
    third = spark.createDataFrame([("X", d(1)), ("X", d(2)), ("X", d(3))], "ticker string, date date")
    assert [tuple(r) for r in health.islands(third, days.where(F.col("date") != F.lit(d(2)))).collect()] == [(d(1), d(3), "X")]


def test_summary_median_is_exact(spark):
    rows = [("T", DAY + dt.timedelta(i), "c", 10, i, v, v == 0, v < 0.9) for i, v in enumerate([0.0, 0.2, 0.7, 1.0])]
    report = spark.createDataFrame(rows, "ticker string, date date, asset_class string, expected_minutes long, actual_minutes long, completeness double, is_whole_day_gap boolean, needs_refetch boolean")
    r = health.summarize(report).first()
    assert (r["tickers"], r["with_whole_day_gap"], r["with_refetch"]) == (1, 1, 1)
    assert r["median_completeness"] == pytest.approx(0.45) and r["mean_completeness"] == pytest.approx(0.475)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "A", 1, 0), (2, "A", 2, 0)], "t int, k string, v int, i int")
    new = spark.createDataFrame([(2, "A", 5, 0), (2, "A", 6, 1), (3, "A", 7, 2)], "t int, k string, v int, i int")
    once = upsert.upsert(old, new, ["t", "k"], ["i"])
    assert sorted(r["v"] for r in once.collect()) == [1, 6, 7]
    twice = upsert.upsert(once, new, ["t", "k"], ["i"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_write_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, 0)], "t int, v int, i int")
    old.write.parquet(str(tmp_path / "a"))
    upsert.write_upsert(spark, str(tmp_path / "a"), str(tmp_path / "b"), spark.createDataFrame([(1, 2, 0), (2, 3, 0)], old.schema), ["t"], ["i"], partition="t")
    assert sorted((r["t"], r["v"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [(1, 2), (2, 3)]


def test_snapshot_replace_keeps_ranks_beyond(spark):
    old = spark.createDataFrame([(9, i, "old") for i in (1, 2, 3)], "h int, rank int, v string")
    new = spark.createDataFrame([(9, i, "new") for i in (1, 2)], old.schema)
    assert sorted(tuple(r)[1:] for r in upsert.snapshot_replace(old, new, ["h", "rank"]).collect()) == [(1, "new"), (2, "new"), (3, "old")]


def test_ordered_union_and_changes(spark):
    f = lambda names: spark.createDataFrame(list(enumerate(names)), "pos int, t string")
    got = upsert.ordered_union([f(["Z", "A"]), f(["A", "B", "C"])], "t", "pos").orderBy("src", "pos").collect()
    assert [r["t"] for r in got] == ["Z", "A", "B", "C"]
    moved = upsert.changes(f(["A", "B"]).select("t"), f(["B", "C"]).select("t"), "t").collect()
    assert sorted(map(tuple, moved)) == [("A", "add"), ("C", "remove")]


@pytest.mark.parametrize(("raw", "want"), [("$1,365.50", 1365.5), ("-7.95%", -7.95), ("+$44.4k", 44400), ("×250", 250), ("-$1.2M", -1200000), ("1.2B", None), ("5d", None), ("", None), (" 3 ", 3), ("1_000", None)])
def test_number(spark, raw, want):
    got = one(spark, text.number(F.col("s")), s=raw)
    assert got == (pytest.approx(want) if want is not None else None)


def test_symbols(spark):
    crypto = {"BTCUSDT", "ETHBTC", "XXETH", "SHIBUSD"}
    for s in [*crypto, "ABNB", "SETH", "USDT", "DOGEUSD"]:
        assert one(spark, text.asset_class(F.col("s")), s=s) == ("cryptos" if s in crypto else "equities")
    assert one(spark, text.dotted(F.col("s")), s="BF-A") == "BF.A"
    assert one(spark, text.dotted(F.col("s")), s="ABC-USD") == "ABC-USD"
    assert one(spark, text.dashed(F.col("s")), s="brk.b ") == "BRK-B"
    assert one(spark, text.base_asset(F.col("s")), s="ETHBTC") == "ETH"
    assert one(spark, text.base_asset(F.col("s")), s="USDT") == ""
    assert one(spark, text.percent(F.col("x")), x=0.0625) == "6.2%"
    assert one(spark, text.head_list(F.split("s", ","), 2), s="a,b,c") == "a, b..."
    assert one(spark, text.or_else(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, text.chunks(F.split("s", ","), 3, list("xyz")), s="a,b") == []


def test_number_functions(spark):
    assert one(spark, numbers.finite(F.col("x")), x=float("inf")) is None
    assert one(spark, numbers.completeness(F.lit(3), F.lit(0)), x=1) is None
    now = dt.datetime(2024, 1, 5)
    day = dt.timedelta(days=1)
    assert numbers.pull_start(now - day, now) == now - day
    assert numbers.pull_start(now - day - dt.timedelta(seconds=1), now) == now - day - dt.timedelta(seconds=1)
    assert numbers.pull_start(None, now) == now - day
    old, new = F.lit("2024-01-01 23:59:00").cast("timestamp"), F.lit("2024-01-02 00:01:00").cast("timestamp")
    assert one(spark, numbers.stale_by_days(old, new, 1), x=1) is True
    assert one(spark, numbers.stale_by_hours(F.lit("2024-01-01 18:01:00").cast("timestamp"), new, 6.0), x=1) is True


def test_top_trades(spark):
    lines = ["NVDA", "×250", "+$44.4k", "TSLA", "$400C 8/15", "×10", "-$1.2k", "AAPL"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(panels.top_trades(F.col("l")).alias("t")).first()["t"]
    assert [tuple(r) for r in got] == [("NVDA", None, 250.0, 44400.0), ("TSLA", "$400C 8/15", 10.0, -1200.0)]


def test_sections(spark):
    lines = ["Closed", "Me", "NVDA", "$10", "+1%", "MENTIONS 24H", "TABLE", "NVDA", "$10", "+1%", "5", "CONNECT & VERIFY", "SENTIMENT", "x"]
    rows = [("\n".join(lines),), ("",), (None,), ("no header\nABC\n1",), ("SENTIMENT\na\nSENTIMENT\nb",)]
    got = panels.sections(spark.createDataFrame(rows, "text string")).collect()
    assert got[0]["strip"] == ["NVDA", "$10", "+1%"] and got[0]["blocks"] == {"MENTIONS 24H": ["NVDA", "$10", "+1%", "5"]}
    assert got[1]["strip"] == got[2]["strip"] == [] and got[2]["blocks"] == {}
    assert got[3]["strip"] == ["ABC", "1"]
    assert got[4]["blocks"] == {"SENTIMENT": ["b"]}


def test_movers_keep_the_first_of_a_ticker(spark):
    """In order of place, however often tickers repeat."""
    for names in (["B", "A", "B", "C", "A"], [], ["A"] * 4, [f"T{i * 7 % 11}" for i in range(60)]):
        rows = [(n, float(i)) for i, n in enumerate(names)]
        lines = [x for n, v in rows for x in (n, str(v), "+1%")]
        got = spark.createDataFrame([(lines,)], "l array<string>").select(panels.movers(F.col("l")).alias("m")).first()["m"]
        assert [(r["ticker"], r["price"]) for r in got] == [(n, v) for i, (n, v) in enumerate(rows) if n not in names[:i]]


@pytest.mark.parametrize("swap", [False, True])
def test_sentiment(spark, swap):
    base, alt = ["62% Bull", "NVDA", "24:2", "92%"], ["38% Bear", "TSLA", "1:9", "90%"]
    df = spark.createDataFrame([(alt, base) if swap else (base, alt)], "a array<string>, b array<string>")
    r = df.select(panels.sentiment(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert (r["bullish_pct"], r["bearish_pct"]) == (62.0, 38.0)
    assert [tuple(x) for x in r["most_bullish"]] == [("NVDA", "24:2", 92.0)] and [tuple(x) for x in r["most_bearish"]] == [("TSLA", "1:9", 90.0)]


def test_extract_and_tables(spark):
    base = "AAA\n$1\n+1%\nAAA\n$2\n+2%\nMENTIONS 24H\nBBB\n$3\n-1%\n7\nSENTIMENT\n60% Bull\nBBB\n3:1\n75%\nLEADERBOARD\nann\n12\nTOP HOLDINGS\nCCC\n$5\n0%\n9"
    views = [("base", base), ("leaderboard_alt", "LEADERBOARD\nSTREAKS\nann\n5d"), ("sentiment_alt", "SENTIMENT\n40% Bear\nDDD\n1:2\n66%")]
    at = dt.datetime(2024, 1, 1, 9, 30)
    made = panels.tables(panels.extract(spark.createDataFrame([(at, v, t) for v, t in views], "capture_ts timestamp_ntz, view string, text string")))
    rows = {k: [tuple(r) for r in df.collect()] for k, (df, _) in made.items()}
    hour = dt.datetime(2024, 1, 1, 9)
    assert rows["panel_sentiment"] == [(hour, 40.0, 60.0)]
    assert rows["panel_biggest_movers"] == [(hour, 1, "AAA", 1.0, 1.0)]
    assert rows["panel_mentions"] == [(hour, 1, "BBB", 3.0, -1.0, 7.0)]
    assert rows["panel_leaderboard_streaks"] == [(hour, 1, "ann", 5.0)]
    assert rows["panel_top_trades"] == []


def test_listing(spark):
    body = '{"data": {"children": [{"data": {"id": "a", "title": "Daily Discussion", "permalink": "/r/x", "created_utc": 5}}, {"data": {"id": "b", "title": "What Are Your Moves"}}]}}'
    now = F.lit("2024-01-01").cast("timestamp")
    posts = panels.parse_listing(spark.createDataFrame([(body,)], "body string"), now, "https://example.org")
    assert [(r["id"], r["url"]) for r in posts.orderBy("id").collect()] == [("a", "https://example.org/r/x"), ("b", "")]
    assert panels.pick_post(posts, "daily").first()["id"] == "a"
    assert panels.pick_post(posts, "any").first()["id"] == "b"
    assert panels.pick_post(posts, "nothing like it").count() == 0


def _levels(spark, prices):
    return spark.createDataFrame([("k", i, float(p), 1.0) for i, p in enumerate(prices)], "k string, pos int, price double, size double")


def test_depth_bucketing(spark):
    got = orderbook.bucket_levels(_levels(spark, range(11)), ["k"]).orderBy("level").collect()
    assert [r["price"] for r in got] == [i + 0.5 for i in range(10)] and [r["size"] for r in got] == [1] * 9 + [2]
    assert [r["price"] for r in orderbook.bucket_levels(_levels(spark, range(10, 0, -1)), ["k"]).orderBy("level").collect()] == list(range(10, 0, -1))
    flat = orderbook.bucket_levels(_levels(spark, [7] * 11), ["k"]).orderBy("level").collect()
    assert flat[0]["price"] == 7.5 and [r["size"] for r in flat] == [11] + [0] * 9


def test_books(spark):
    books = spark.createDataFrame([(dt.datetime(2024, 1, 1), "US.X", [(2.0, 5.0), (1.0, 6.0)], [(3.0, 7.0)])], "ts timestamp, code string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    assert orderbook.snapshots(books).count() == 3
    assert orderbook.book_text(orderbook.book_levels(books)).first()["text"].splitlines()[0].split() == ["3.00", "7"]


def test_decisions(spark):
    targets = spark.createDataFrame([("A", 0.6), ("B", -0.4), ("C", 0.0)], "symbol string, weight double")
    held = spark.createDataFrame([("B",), ("C",), ("D",)], "symbol string")
    got = decisions.rebalance(targets, held).orderBy("seq").collect()
    assert [(r["kind"], r["symbol"], r["side"], r["weight"]) for r in got] == [("open", "A", "buy", 0.6), ("close", "C", None, None), ("close", "D", None, None)]


def test_order_requests(spark):
    rows = [("A", "open", "buy", None, 0.5, None), ("B", "close", None, None, None, 0.25), ("C", "open", "buy", 3.0, None, None)]
    df = spark.createDataFrame(rows, "symbol string, kind string, side string, qty double, weight double, fraction double")
    prices = spark.createDataFrame([("A", 10.0)], "symbol string, price double")
    got = {r["symbol"]: r for r in decisions.order_requests(df, prices, 1000.0).collect()}
    assert got["A"]["qty"] == 50 and got["B"]["close_percent"] == 25 and got["C"]["qty"] == 3
    for bad in (("A", "sell it", None, None, None, None), ("A", "open", "buy", 1.0, 0.5, None)):
        with pytest.raises(Exception, match="decision"):
            decisions.order_requests(spark.createDataFrame([bad], df.schema), prices, 1.0).collect()
    orders = spark.createDataFrame([("o", "A", "buy", None, "stop", None)], "order_id string, symbol string, side string, qty double, order_type string, limit_price double")
    assert tuple(decisions.broker_orders(orders).first()) == ("o", "A", "buy", 0.0, "market", None)


def _bars(spark, closes, ticker="T"):
    rows = [(ticker, dt.datetime(2024, 1, 1 + i), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, datetime timestamp, close double")


def test_crossover_and_momentum(spark):
    last = lambda c: indicators.last_rows(indicators.crossovers(_bars(spark, c), 2, 3)).first()["cross"]
    assert last([3, 2, 1, 5]) == "above" and last([3, 2, 1]) is None
    assert indicators.momentum(_bars(spark, [10, 11, 12]), 3).first()["signal"] == pytest.approx(0.2)
    assert indicators.momentum(_bars(spark, [10, 11]), 3).count() == 0
    held = spark.createDataFrame([("Z",)], "symbol string")
    assert decisions.momentum_strategy(3)(_bars(spark, [10, 11]), held).count() == 0
    assert [r["kind"] for r in decisions.momentum_strategy(3)(_bars(spark, [10, 11, 12]), held).orderBy("seq").collect()] == ["open", "close"]
    bought = decisions.sma_cross_strategy(2, 3)(_bars(spark, [3, 2, 1, 5]), held).collect()
    assert [(r["kind"], r["symbol"], r["weight"]) for r in bought] == [("open", "T", 0.1)]


def test_catch_up(spark):
    row = "ticker string, datetime int, v string"
    history = spark.createDataFrame([("T", 1, "a"), ("T", 2, "b")], row)
    live = spark.createDataFrame([("T", 2, "b2"), ("T", 3, "c")], row)
    assert [r["v"] for r in bars.catch_up(history, live, ["v"]).orderBy("datetime").collect()] == ["a", "b2", "c"]


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(1, 1.0, None, None, None)], "datetime int, A_open double, A_close double, B_open double, B_close double")
    assert [tuple(r) for r in bars.from_wide(wide, ["A", "B"], ["open", "close"]).collect()] == [(1, "A", 1.0, None)]


def test_resolve_ids(spark):
    cand = lambda ranks: spark.createDataFrame([("BTC", f"c{i}", r, i) for i, r in enumerate(ranks, 1)], "base string, id string, rank double, src_pos int")
    base = spark.createDataFrame([("BTC",), ("NONE",)], "base string")
    first = lambda ranks: [r["id"] for r in screening.resolve_ids(base, cand(ranks)).collect()]
    assert first([None, 5.0, 1.0]) == ["c3"] and first([None, 0.0]) == ["c1"] and first([float("nan"), 2.0]) == ["c2"] and first([None]) == ["c1"]
    assert screening.ambiguous(cand([1.0])).count() == 0


def test_screens(spark):
    eq = spark.createDataFrame([("A", 100000.0, 5.0, "stock", True), ("B", 99999.0, 9.0, "stock", True), ("C", 2e5, 7.0, "stock", False)], "name string, average_volume_60d_calc double, market_cap_basic double, type string, is_primary boolean")
    assert [r["name"] for r in screening.screen_equities(eq).collect()] == ["A"]
    etf = spark.createDataFrame([("S", "fund", ["etf"], 100000.0, 6e8), ("T", "fund", ["etf"], 100001.0, 6e8), ("U", "fund", ["etf"], 2e5, 5e8)], "name string, type string, typespecs array<string>, average_volume_60d_calc double, aum double")
    assert [r["name"] for r in screening.screen_etfs(etf).collect()] == ["T"]
    coins = spark.createDataFrame([("X", 3.0), ("Y", 2.0), ("W", 1.0)], "name string, volume double")
    quotes = spark.createDataFrame([("X", "USD"), ("Y", "USDT")], "symbol string, quoteAsset string")
    assert sorted(r["name"] for r in screening.screen_cryptos(coins, quotes).collect()) == ["W", "Y"]


def test_reference_data(spark):
    raw = spark.createDataFrame([("A", "equities", '{"longName": "", "shortName": "a", "marketCap": 5, "beta": "Infinity"}')], "ticker string, asset_class string, raw string")
    assert tuple(screening.equity_metadata(raw).select("name", "market_cap").first()) == ("a", 5.0)
    assert screening.fundamentals(raw, "equities", "weekly").first()["beta"] is None
    assert screening.fundamentals(raw, "cryptos", "weekly").columns == ["ticker"]
    symbols = spark.createDataFrame([("BTCUSDT", "BTC"), ("QQUSDT", "QQ")], "symbol string, base string")
    coins = spark.createDataFrame([(0, "bitcoin", "btc", "Bitcoin"), (1, "other", "btc", "Other")], "src_pos long, id string, symbol string, name string")
    markets = spark.createDataFrame([("bitcoin", "Bitcoin", 9.0, 1.0, 1.0, 2.0, 2.0)], "id string, name string, market_cap double, market_cap_rank double, circulating_supply double, max_supply double, total_supply double")
    assert [r["ticker"] for r in screening.crypto_fundamentals(symbols, coins, markets).collect()] == ["BTCUSDT"]
    assert [r["base"] for r in screening.unmatched(symbols, coins).collect()] == ["QQ"]
    assert screening.crypto_fundamentals(symbols.limit(0), coins, markets).count() == 0


def test_calendar(spark):
    cal = calendars.exchange_calendar(spark, dt.date(2021, 1, 1), dt.date(2026, 12, 31)).withColumn("m", numbers.minutes_between(F.col("market_open"), F.col("market_close")))
    per_year = {r[0]: r[1] for r in cal.groupBy(F.year("date")).count().collect()}
    assert [per_year[y] for y in range(2021, 2027)] == [252, 251, 250, 252, 250, 251]  # 2025 has a one-off closure
    assert sorted(str(r["date"]) for r in cal.where("m = 210 and year(date) = 2024").collect()) == ["2024-07-03", "2024-11-29", "2024-12-24"]
    days = {str(r["date"]) for r in cal.collect()}
    assert not days & {"2024-03-29", "2023-04-07", "2021-12-24", "2022-06-20", "2024-01-15"} and "2021-12-31" in days
    assert cal.where("m not in (210, 390)").count() == 0
    assert calendars.always_open(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).count() == 366


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("aapl # x\n\n#only\n brk-b\n")
    assert [r["ticker"] for r in files.watchlist(spark, str(tmp_path / "list.txt")).collect()] == ["AAPL", "BRK-B"]
    files.write_watchlist(spark.createDataFrame([("B",), ("A",)], "ticker string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), "no_such")
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path), "panel_sentiment")
    spark.createDataFrame([(dt.datetime(2024, 1, d), 1.0, 2.0) for d in (1, 3)], "date timestamp_ntz, bearish_pct double, bullish_pct double").write.parquet(str(tmp_path / "panel_sentiment"))
    assert files.load(spark, str(tmp_path), "panel_sentiment", dt.datetime(2024, 1, 2)).count() == 1
    files.write_side_file(spark.createDataFrame([("X", None), ("Y", 2)], "ticker string, n int"), str(tmp_path / "side"))
    assert sorted((r["ticker"], r["n"]) for r in spark.read.schema("ticker string, n int").json(str(tmp_path / "side")).collect()) == [("X", None), ("Y", 2)]
    kv = files.keyed_json(spark.createDataFrame([('{"A": {"x": 1}}',)], "body string"), "struct<x:int>").first()
    assert kv["key"] == "A" and kv["value"]["x"] == 1
    control = files.mark_written(spark.createDataFrame([], "name string, written_at timestamp"), "t", F.lit("2024-01-01").cast("timestamp"))
    assert control.count() == 1


def test_snapshots_within_rows(spark):
    """Arrays against rows: sides of all sizes, flat ones, empty and null ones; no shuffle."""
    import random

    rng = random.Random(6)
    sides = [[(float(rng.choice([1, 2, 3.5, 7, 7.25, 11])) if k < 20 else 5.0, float(rng.randint(0, 9))) for _ in range(k)] for k in (0, 1, 9, 10, 11, 12, 19, 40)] + [None]
    level = "array<struct<price: double, size: double>>"
    books = spark.createDataFrame([(i, f"US.{i}", rng.choice(sides), s) for i, s in enumerate(sides * 3)], f"n int, code string, bids {level}, asks {level}").withColumn("ts", F.timestamp_seconds("n"))
    got = orderbook.snapshots(books)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = orderbook.bucket_levels(orderbook.book_levels(books), ["ts", "code", "side"]).select("ts", "code", "side", "level", "price", "size")
    rows = lambda df: sorted((*r[:4], round(r[4], 9), round(r[5], 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_snapshots_of_deep_books(spark):
    """A side's ends are found once, not again for each of its levels: 20,000 levels within a minute."""
    import threading

    level = "array<struct<price: double, size: double>>"
    side = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct((i * 7 % 20_000).cast("double").alias("price"), F.lit(1.0).alias("size"))).cast(level)
    books = spark.range(1).select(F.timestamp_seconds("id").alias("ts"), F.lit("US.A").alias("code"), side.alias("bids"), F.lit(None).cast(level).alias("asks")).repartition(1)
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = orderbook.snapshots(books).orderBy("level").collect()
    finally:
        late.cancel()
    assert [r["size"] for r in got] == [2000.0] * 10 and got[0]["price"] == pytest.approx(999.95)


def test_ratio(spark):
    """Division by zero as in IEEE 754."""
    from quillspark.functions.numbers import ratio

    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.0, inf), (-1.0, 0.0, -inf), (0.0, 0.0, nan), (nan, 0.0, nan), (3.0, 2.0, 1.5), (None, 0.0, None), (1.0, None, None)]
    got = spark.createDataFrame(rows, "a double, b double, want double").select(ratio(F.col("a"), F.col("b")).alias("r"), "want").collect()
    assert all(repr(r[0]) == repr(r[1]) for r in got)

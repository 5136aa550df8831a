"""More registered queries: scalar functions, panels, screens and records over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import numbers, text
from quillspark.operators import bars, decisions, orderbook, panels, screening
from quillspark.plans import views
from quillspark.plans.catalog import HOURLY, TYPES_OF_EVENTS, query, rounded
from quillspark.sources import files
from quillspark.sources.files import table
from quillspark.streaming import live

# Scalar functions


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS DOUBLE) END AS days FROM events")
def streak_days(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("event_id") % 3 == 0, "d").when(F.col("event_id") % 3 == 1, "D").otherwise(" days")
    return views.events(spark, sf).select("event_id", text.streak_days(F.concat(F.col("user_id").cast("string"), mark)).alias("days"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'S' || user_id || '.A' END AS symbol FROM events")
def invalid_symbols(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("code=400 invalid symbol: S"), F.col("user_id").cast("string"), F.lit(".A (retry)"))).otherwise("too many requests")
    return views.events(spark, sf).select("event_id", text.invalid_symbol(message).alias("symbol"))


@query("""SELECT event_id, epoch_ms(event_id * 60000) AS from_ms, CASE WHEN event_id % 2 = 0 THEN epoch_ms(event_id * 1000) ELSE TIMESTAMP '2024-01-01' END AS from_s,
    CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts) END AS from_iso, date_trunc('hour', ts) AS hour FROM events""")
def event_times(spark: SparkSession, sf: str) -> DataFrame:
    k, plain = F.col("event_id"), lambda c: c.cast("timestamp_ntz")
    iso = F.when(k % 5 > 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("not a time")
    return views.events(spark, sf).select(
        "event_id", plain(numbers.from_epoch_ms(k * 60000)).alias("from_ms"), plain(numbers.from_epoch_s(F.when(k % 2 == 0, k), F.lit("2024-01-01").cast("timestamp"))).alias("from_s"),
        plain(numbers.from_iso(iso)).alias("from_iso"), numbers.hour_of(F.col("ts")).cast("timestamp_ntz").alias("hour"),
    )


@query("SELECT event_id, CASE WHEN event_id % 5 > 2 THEN value END AS number FROM events")
def finite_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "NaN").when(k == 1, "-Infinity").when(k == 2, "n/a").otherwise(F.col("value").cast("string"))
    return views.events(spark, sf).select("event_id", numbers.finite(raw).alias("number"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'https://post.example/' ELSE 'https://site.example/r/' END || user_id AS url FROM events")
def post_links(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "https://post.example/").otherwise("/r/"), F.col("user_id").cast("string"))
    return views.events(spark, sf).select("event_id", text.post_id(F.concat(F.lit("t3_"), F.col("event_id").cast("string"))).alias("id"), text.post_url(path, "https://site.example").alias("url"))


@query("""WITH l AS (SELECT event_type, list_sort(list(DISTINCT CAST(user_id AS VARCHAR))) AS a FROM events GROUP BY 1)
    SELECT event_type, array_to_string(a[1:20], ', ') || CASE WHEN len(a) > 20 THEN '...' ELSE '' END AS users FROM l""")
def listed_heads(spark: SparkSession, sf: str) -> DataFrame:
    # 21 names show that there are more than 20; no type's names meet in one row
    each = views.events(spark, sf).select("event_type", F.col("user_id").cast("string").alias("user")).distinct()
    first = each.withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy("user"))).where("i <= 21")
    lists = first.groupBy("event_type").agg(F.sort_array(F.collect_list("user")).alias("a"))
    return lists.select("event_type", text.head_list(F.col("a")).alias("users"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'NVDA' ELSE 'US' || user_id END AS ticker, 'US.' || CASE WHEN event_id % 3 = 0 THEN 'NVDA' ELSE 'US' || user_id END AS code FROM events")
def prefixed_codes(spark: SparkSession, sf: str) -> DataFrame:
    ticker = F.when(F.col("event_id") % 3 == 0, "NVDA").otherwise(F.concat(F.lit("US"), F.col("user_id").cast("string")))
    return views.events(spark, sf).select(ticker.alias("ticker"), orderbook.prefixed(ticker).alias("code"))


# Sources as texts


@query("SELECT event_type || '-' || user_id AS key, max(value) AS value FROM events GROUP BY 1")
def keyed_json(spark: SparkSession, sf: str) -> DataFrame:
    one = views.events(spark, sf).groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    pair = F.struct(F.concat_ws("-", "event_type", F.col("user_id").cast("string")), F.col("v"))
    bodies = one.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("body"))
    return files.keyed_json(bodies, "double")


@query("SELECT c_mktsegment || '-' || c_custkey AS ticker FROM customer WHERE c_custkey % 3 > 0")
def watchlist_lines(spark: SparkSession, sf: str) -> DataFrame:
    name, k = F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")), F.col("c_custkey") % 3
    line = F.when(k == 0, F.concat(F.lit("  # "), name)).when(k == 1, F.concat(F.lit("\t"), F.lower(name), F.lit(" # held"))).otherwise(F.concat(name, F.lit(" ")))
    return files.watchlist_lines(table(spark, sf, "customer").select(line.alias("value")))


@query(f"SELECT datetime, ticker, close, volume FROM ({HOURLY})")
def bars_from_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = views.hourly(spark, sf).groupBy("datetime").pivot("ticker", TYPES_OF_EVENTS).agg(F.first("close").alias("close"), F.first("volume").alias("volume"))
    return bars.from_wide(wide, TYPES_OF_EVENTS, ["close", "volume"])


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' of ' || user_id AS title, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://site.example/r/' || event_id END AS url,
    CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-02-01' ELSE epoch_ms(event_id * 1000) END AS created_utc FROM events""")
def parsed_listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    post = F.struct(
        k.cast("string").alias("id"), F.concat_ws(" of ", "event_type", F.col("user_id").cast("string")).alias("title"),
        F.when(k % 4 > 0, F.concat(F.lit("/r/"), k.cast("string"))).alias("permalink"), F.when(k % 7 > 0, k.cast("double")).alias("created_utc"),
    )
    pages = views.events(spark, sf).groupBy("user_id").agg(F.collect_list(F.struct(post.alias("data"))).alias("children"))
    body = pages.select(F.to_json(F.struct(F.struct("children").alias("data"))).alias("body"))
    got = panels.parse_listing(body, F.lit("2024-02-01").cast("timestamp"), "https://site.example")
    return got.withColumn("created_utc", F.col("created_utc").cast("timestamp_ntz"))


@query("SELECT event_id AS id, ts AS created_utc FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 1")
def picked_post(spark: SparkSession, sf: str) -> DataFrame:
    titles = F.when(F.col("event_type") == "view", "WHAT ARE YOUR MOVES tomorrow").otherwise(F.concat(F.lit("Daily "), F.col("event_type")))
    posts = views.events(spark, sf).select(F.col("event_id").alias("id"), titles.alias("title"), F.col("ts").alias("created_utc"))
    return panels.pick_post(posts, "moves").select("id", "created_utc")


# Panels


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Three views of a panel for each day, with the day's number of events in them."""
    days = views.events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("capture_ts")).agg(F.count(F.lit(1)).alias("n"))
    n = lambda k: (F.col("n") % k).cast("string")
    made = {
        "base": F.concat(F.lit("SENTIMENT\n"), n(100), F.lit("% Bull\nNVDA\n24:2\n92%\nAMD\n9:1\n"), n(7), F.lit("%\nLEADERBOARD\nann\n"), n(50), F.lit("\nbob\n1.5k\ncut")),
        "leaderboard_alt": F.concat(F.lit("LEADERBOARD\nSTREAKS\nann\n"), n(9), F.lit("d")),
        "sentiment_alt": F.concat(F.lit("SENTIMENT\n"), n(90), F.lit("% Bear\nTSLA\n1:9\n90%\nCONNECT & VERIFY")),
    }
    views_ = F.array(*(F.struct(F.lit(k).alias("view"), v.alias("text")) for k, v in made.items()))
    return days.select("capture_ts", F.explode(views_).alias("v")).select("capture_ts", "v.*")


DAYS = "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS date, count(*) AS n FROM events GROUP BY 1)"


@query(f"{DAYS} SELECT date, CAST(n % 90 AS DOUBLE) AS bearish_pct, CAST(n % 100 AS DOUBLE) AS bullish_pct FROM d")
def panel_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return panels.tables(panels.extract(captures(spark, sf)))["panel_sentiment"][0]


@query(f"{DAYS} SELECT date, CAST(1 AS BIGINT) AS rank, 'NVDA' AS ticker, '24:2' AS split, 92E0 AS pct FROM d UNION ALL SELECT date, 2, 'AMD', '9:1', CAST(n % 7 AS DOUBLE) FROM d")
def panel_most_bullish(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = panels.tables(panels.extract(captures(spark, sf)))["panel_sentiment_most_bullish"]
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(f"{DAYS} SELECT date, CAST(1 AS BIGINT) AS rank, 'ann' AS username, CAST(n % 50 AS DOUBLE) AS count FROM d UNION ALL SELECT date, 2, 'bob', 1500E0 FROM d")
def panel_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = panels.tables(panels.extract(captures(spark, sf)))["panel_leaderboard"]
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(f"{DAYS} SELECT date, CAST(1 AS BIGINT) AS rank, 'ann' AS username, CAST(n % 9 AS DOUBLE) AS streak_days FROM d")
def panel_leaderboard_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = panels.tables(panels.extract(captures(spark, sf)))["panel_leaderboard_streaks"]
    return rows.withColumn("rank", F.col("rank").cast("long"))


# Screens and records


@query("""SELECT p_name AS name, p_retailprice AS market_cap_basic FROM part WHERE p_retailprice * 90 >= 100000 AND p_size % 3 > 0 AND p_size % 2 = 0 ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 2000""")
def screened_equities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), (F.col("p_retailprice") * 90).alias("average_volume_60d_calc"), F.when(F.col("p_size") % 3 > 0, "stock").otherwise("dr").alias("type"),
        (F.col("p_size") % 2 == 0).alias("is_primary"), F.col("p_retailprice").alias("market_cap_basic"),
    )
    return screening.screen_equities(p).select("name", "market_cap_basic")


@query("SELECT s_name AS name, s_acctbal * 1e6 AS aum FROM supplier WHERE s_suppkey % 4 > 0 AND s_acctbal * 1e6 > 5e8 AND s_suppkey * 1000 + 99000 > 100000 ORDER BY s_acctbal * 1e6 DESC, s_name LIMIT 200")
def screened_etfs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.lit("fund").alias("type"), F.when(F.col("s_suppkey") % 4 > 0, F.array(F.lit("etf"))).otherwise(F.array(F.lit("unit"))).alias("typespecs"),
        (F.col("s_suppkey") * 1000 + 99000).cast("double").alias("average_volume_60d_calc"), (F.col("s_acctbal") * 1e6).alias("aum"),
    )
    return screening.screen_etfs(s).select("name", "aum")


COINS = """
    n AS (SELECT upper(n_name) || 'USDT' AS ticker, upper(n_name) AS base, n_nationkey FROM nation WHERE n_nationkey % 4 > 0),
    k AS (SELECT n.ticker, s.* FROM n JOIN supplier s ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n.base ORDER BY CASE WHEN s_suppkey % 3 > 0 THEN nullif(abs(s_acctbal), 0) END NULLS LAST, s_suppkey) = 1)
"""


@query(f"WITH {COINS} SELECT ticker, s_acctbal AS market_cap, CAST(s_suppkey AS DOUBLE) AS circulating_supply, CASE WHEN s_suppkey % 3 > 0 THEN abs(s_acctbal) END AS market_cap_rank, 1E0 AS max_supply, 2E0 AS total_supply FROM k")
def coin_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", F.upper("n_name").alias("base"))
    symbols = nations.where("n_nationkey % 4 > 0").select(F.concat("base", F.lit("USDT")).alias("symbol"), "base")
    s = table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are fixed
    coins = s.select(F.lower("base").alias("symbol"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("src_pos"))
    markets = s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("market_cap"), F.col("s_suppkey").cast("double").alias("circulating_supply"),
        F.when(F.col("s_suppkey") % 3 > 0, F.abs("s_acctbal")).alias("market_cap_rank"), F.lit(1.0).alias("max_supply"), F.lit(2.0).alias("total_supply"),
    )
    return screening.crypto_fundamentals(symbols, coins, markets)


@query("SELECT ts, event_type AS ticker, value FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) >= (SELECT avg(value) FROM events))")
def subscribed_rows(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf).select("ts", F.col("event_type").alias("ticker"), "value")
    watched = ev.groupBy("ticker").agg(F.avg("value").alias("m")).join(ev.agg(F.avg("value").alias("all"))).where("m >= all").select("ticker")
    return live.subscriptions(ev, watched)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice ELSE 0 END AS qty,
    CASE WHEN o_orderkey % 3 = 0 THEN 'limit' ELSE 'market' END AS order_type, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS limit_price FROM orders""")
def open_orders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        k.cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"),
        F.when(k % 5 > 0, F.col("o_totalprice")).alias("qty"), F.when(k % 3 == 0, "limit").when(k % 3 == 1, "stop").otherwise("market").alias("order_type"), F.when(k % 3 == 0, F.col("o_totalprice") / 2).alias("limit_price"),
    )
    return decisions.broker_orders(raw)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE c_custkey % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'open' ELSE 'replace' END AS kind, CASE WHEN c_custkey % 3 = 1 THEN 'buy' END AS side,
    round(CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE 0.25E0 * 1000 / nullif(c_acctbal, 0) END END, 6) AS qty,
    CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 4 THEN 100E0 ELSE (c_custkey % 5) / 4E0 * 100 END END AS close_percent FROM customer""")
def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Opens by quantity or by weight, and closes by fraction."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    made = c.select(
        k.cast("string").alias("symbol"), F.when(k % 3 == 0, "close").when(k % 3 == 1, "open").otherwise("replace").alias("kind"), F.when(k % 3 == 1, "buy").alias("side"),
        F.when((k % 3 == 1) & (k % 2 == 0), k.cast("double")).alias("qty"), F.when((k % 3 == 1) & (k % 2 == 1), 0.25).alias("weight"), F.when(k % 3 == 0, (k % 5) / 4).alias("fraction"),
    )
    return rounded(decisions.order_requests(made, c.select(k.cast("string").alias("symbol"), F.col("c_acctbal").alias("price")), 1000.0))


@query("""
    WITH l AS (SELECT CAST(ts AS DATE) AS ts, event_type AS code, event_id % 2 AS side, event_id, printf('%10.2f %8.0f', CAST(event_id % 100 AS DOUBLE), CAST(event_id % 7 AS DOUBLE)) AS line FROM events),
    s AS (SELECT ts, code, string_agg(line, chr(10) ORDER BY event_id DESC) FILTER (side = 1) AS a, string_agg(line, chr(10) ORDER BY event_id) FILTER (side = 0) AS b FROM l GROUP BY 1, 2)
    SELECT ts, code, coalesce(a || chr(10), '') || repeat('-', 19) || coalesce(chr(10) || b, '') AS text FROM s
""")
def book_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    side = F.when(k % 2 == 1, "ask").otherwise("bid")
    levels = views.events(spark, sf).select(F.to_date("ts").alias("ts"), F.col("event_type").alias("code"), side.alias("side"), k.alias("pos"), (k % 100).cast("double").alias("price"), (k % 7).cast("double").alias("size"))
    return orderbook.book_text(levels)


@query("SELECT user_id AS ticker, event_id AS pos, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return panels.first_by_ticker(views.events(spark, sf).select(F.col("user_id").alias("ticker"), F.col("event_id").alias("pos"), "value"))


@query("SELECT event_type AS ticker, CAST(l.ts AS DATE) AS date, count(*) AS n FROM events l GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, date) <= 3")
def busiest_days(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy(F.col("n").desc(), "date")
    return views.minutes(spark, sf, "event_type").withColumn("r", F.row_number().over(w)).where("r <= 3").select("ticker", "date", "n")

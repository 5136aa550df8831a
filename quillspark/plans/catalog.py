"""Registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import numbers, text
from quillspark.operators import allocation, bars, decisions, health, indicators, orderbook, panels, screening, upsert
from quillspark.plans import views
from quillspark.sources import calendars, files
from quillspark.sources.files import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# Bars and selections

HOURLY = """
    SELECT event_type AS ticker, date_trunc('hour', ts) AS datetime, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        max_by(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY 1, 2
"""
# The event types of the test tables.
TYPES_OF_EVENTS = ["click", "error", "purchase", "signup", "view"]
DAILY = HOURLY.replace("event_type AS ticker", "CAST(user_id AS VARCHAR) AS ticker").replace("'hour'", "'day'")


@query(HOURLY)
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return views.hourly(spark, sf)


@query(f"SELECT * FROM ({HOURLY}) WHERE ticker IN ('click', 'view', 'purchase') AND datetime >= TIMESTAMP '2024-01-05' AND datetime <= TIMESTAMP '2024-01-20'")
def bars_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return bars.select_bars(views.hourly(spark, sf), ["click", "view", "purchase"], F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-20")))


@query("SELECT DISTINCT event_type AS ticker FROM events")
def distinct_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return files.symbols(views.events(spark, sf).select(F.col("event_type").alias("ticker"), "value"))


@query(f"SELECT min(last) AS start FROM (SELECT ticker, max(datetime) AS last FROM ({DAILY}) GROUP BY ticker)")
def incremental_start(spark: SparkSession, sf: str) -> DataFrame:
    return bars.incremental_start(views.daily_by_user(spark, sf))


@query(f"SELECT ticker, datetime, close FROM ({HOURLY}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY datetime DESC) <= 5")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return bars.tail(views.hourly(spark, sf), 5).select("ticker", "datetime", "close")


@query(f"""SELECT datetime, {', '.join(f"max(CASE WHEN ticker = '{t}' THEN close END) AS {t}" for t in TYPES_OF_EVENTS)} FROM ({HOURLY.replace("'hour'", "'day'")}) GROUP BY 1""")
def close_matrix(spark: SparkSession, sf: str) -> DataFrame:
    made = bars.bars(views.events(spark, sf), "day", ticker="event_type", ts="ts", price="value", order=["ts", "event_id"])
    return bars.close_matrix(made, TYPES_OF_EVENTS)


@query("SELECT ts, event_type, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def retention_window(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf)
    now = ev.agg(F.max("ts").alias("now"))
    return bars.retained(ev.withColumn("datetime", F.col("ts")).join(F.broadcast(now)), F.col("now"), "1 day").select("ts", "event_type", "value")


@query("""
    WITH u AS (SELECT DISTINCT user_id AS ticker FROM events UNION ALL SELECT -1), s AS (SELECT user_id AS ticker, max(ts) AS last_seen FROM events GROUP BY 1)
    SELECT u.ticker, last_seen FROM u LEFT JOIN s USING (ticker) WHERE coalesce(last_seen <= (SELECT max(ts) - INTERVAL 2 DAY FROM events), true)
""")
def silent_tickers(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf).select(F.col("user_id").alias("ticker"), F.col("ts").alias("datetime"))
    now = ev.agg((F.max("datetime") - F.expr("interval 2 days")).alias("since"))
    never = spark.range(-1, 0).select(F.col("id").alias("ticker"))
    universe = ev.select("ticker").distinct().unionByName(never).join(F.broadcast(now))  # one row
    return bars.silent(universe, ev, F.col("since")).select("ticker", "last_seen")


@query(f"""
    WITH h AS (SELECT *, 0 AS src FROM ({HOURLY}) WHERE datetime < TIMESTAMP '2024-01-16'),
    l AS (SELECT ticker, datetime, open, high, low, close + 1 AS close, volume, 1 AS src FROM ({HOURLY}) WHERE datetime >= TIMESTAMP '2024-01-15')
    SELECT ticker, datetime, open, high, low, round(close, 6) AS close, volume FROM (SELECT * FROM h UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY ticker, datetime ORDER BY src DESC) = 1
""")
def snapshot_tail_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = views.hourly(spark, sf)
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    return rounded(bars.catch_up(b.where(F.col("datetime") < at("2024-01-16")), b.where(F.col("datetime") >= at("2024-01-15")).withColumn("close", F.col("close") + 1), ["volume"]))


# Data health

REPORT = """
    WITH cal AS (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY))::DATE AS date),
    tick AS (SELECT DISTINCT {key} AS ticker FROM events {extra}),
    n AS (SELECT {key} AS ticker, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2),
    report AS (
        SELECT ticker, date, 'cryptos' AS asset_class, CAST({expected} AS BIGINT) AS expected_minutes, coalesce(n, 0) AS actual_minutes,
            least(coalesce(n, 0) / {expected}E0, 1E0) AS completeness, coalesce(n, 0) = 0 AS is_whole_day_gap, least(coalesce(n, 0) / {expected}E0, 1E0) < 0.9E0 AS needs_refetch
        FROM tick CROSS JOIN cal LEFT JOIN n USING (ticker, date)
    )
"""
TYPES = REPORT.format(key="event_type", expected=70, extra="")
USERS = REPORT.format(key="CAST(user_id AS VARCHAR)", expected=1440, extra="UNION ALL SELECT 'DEAD' AS ticker")


def _type_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = views.minutes(spark, sf, "event_type")
    tickers = counts.select("ticker").distinct().withColumn("asset_class", F.lit("cryptos"))
    return health.gap_report(tickers, views.calendar(spark, sf, views.EXPECTED_PER_DAY), counts)


def _user_report(spark: SparkSession, sf: str) -> DataFrame:
    """Users and one ticker without any event, against whole days."""
    counts = views.minutes(spark, sf, "user_id")
    dead = spark.createDataFrame([("DEAD",)], "ticker string")
    tickers = counts.select("ticker").distinct().unionByName(dead).withColumn("asset_class", F.lit("cryptos"))
    return health.gap_report(tickers, views.calendar(spark, sf, 1440), counts)


@query("SELECT event_type AS ticker, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2")
def minute_counts(spark: SparkSession, sf: str) -> DataFrame:
    return health.minute_counts(views.events(spark, sf).select(F.col("event_type").alias("ticker"), F.col("ts").alias("datetime")))


@query(f"{TYPES} SELECT * FROM report")
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return _type_report(spark, sf)


@query(f"{USERS} SELECT * FROM report")
def gap_report_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return _user_report(spark, sf)


CLASSED = f"{USERS}, r AS (SELECT * REPLACE (CASE WHEN length(ticker) % 2 = 0 THEN 'even' ELSE 'odd' END AS asset_class) FROM report)"


@query(f"""{CLASSED}, t AS (SELECT asset_class, ticker, bool_or(is_whole_day_gap) AS g, bool_or(needs_refetch) AS n FROM r GROUP BY 1, 2),
    a AS (SELECT asset_class, count(*) AS tickers, count(*) FILTER (g) AS with_whole_day_gap, count(*) FILTER (n) AS with_refetch FROM t GROUP BY 1),
    b AS (SELECT asset_class, round(avg(completeness), 6) AS mean_completeness, round(median(completeness), 6) AS median_completeness FROM r GROUP BY 1)
    SELECT * FROM a JOIN b USING (asset_class)""")
def gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    report = _user_report(spark, sf).withColumn("asset_class", F.when(F.length("ticker") % 2 == 0, "even").otherwise("odd"))
    return rounded(health.summarize(report))


@query(f"""{USERS} SELECT ticker, min(asset_class) AS asset_class, round_even(avg(completeness) * 100, 1) AS mean_pct, count(*) FILTER (is_whole_day_gap) AS whole_day_gaps,
    count(*) FILTER (needs_refetch) AS refetch_days, min(date) FILTER (actual_minutes > 0) AS first_date_present, max(date) FILTER (actual_minutes > 0) AS last_date_present
    FROM report GROUP BY ticker ORDER BY round(avg(completeness), 9), ticker LIMIT 20""")
def worst_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return health.worst_coverage(_user_report(spark, sf), 20)


@query(f"{USERS} SELECT ticker, min(asset_class) AS asset_class FROM report GROUP BY ticker HAVING avg(completeness) = 0")
def dead_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return health.dead_tickers(_user_report(spark, sf))


# The days of the test tables.
DAYS_OF_EVENTS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@query(f"{TYPES} SELECT ticker, {', '.join(f"""max(CASE WHEN date = DATE '{d}' THEN completeness END) AS "{d}\"""" for d in DAYS_OF_EVENTS)}, round(avg(completeness), 6) AS mean FROM report GROUP BY ticker ORDER BY avg(completeness), ticker LIMIT 3")
def coverage_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    wide = health.heatmap(_type_report(spark, sf), DAYS_OF_EVENTS, 3)
    return wide.withColumn("mean", F.round("mean", 6))


@query(f"{TYPES} SELECT ticker, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates FROM report WHERE needs_refetch GROUP BY 1")
def missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    return health.missing_by_ticker(_type_report(spark, sf)).select("ticker", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"))


@query(f"{USERS} SELECT count(*) FILTER (needs_refetch) AS to_fetch, count(*) FILTER (NOT needs_refetch) AS complete FROM report")
def refetch_totals(spark: SparkSession, sf: str) -> DataFrame:
    return health.report_totals(_user_report(spark, sf))


@query("""
    WITH cal AS (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY))::DATE AS date),
    u AS (SELECT DISTINCT user_id FROM events),
    miss AS (SELECT user_id, date FROM u CROSS JOIN cal EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events),
    s AS (SELECT date, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS tickers FROM miss GROUP BY 1),
    d AS (SELECT date, tickers, row_number() OVER (ORDER BY date) AS i FROM cal LEFT JOIN s USING (date)),
    c AS (SELECT *, CASE WHEN tickers IS NOT DISTINCT FROM lag(tickers) OVER (ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS chg FROM d),
    r AS (SELECT *, sum(chg) OVER (ORDER BY i) AS run FROM c)
    SELECT min(date) AS start, max(date) AS "end", tickers FROM r WHERE tickers IS NOT NULL GROUP BY run, tickers
""")
def gap_islands(spark: SparkSession, sf: str) -> DataFrame:
    counts = views.minutes(spark, sf, "user_id")
    tickers = counts.select("ticker").distinct().withColumn("asset_class", F.lit("cryptos"))
    cal = views.calendar(spark, sf, 1440)
    report = health.gap_report(tickers, cal, counts)
    return health.islands(report.where("is_whole_day_gap"), cal)


@query(f"""{USERS}, s AS (SELECT ticker, min(date) AS low, max(date) AS high FROM report WHERE is_whole_day_gap GROUP BY 1),
    b AS (SELECT *, (row_number() OVER (ORDER BY ticker) - 1) // 100 AS batch FROM s)
    SELECT batch, min(ticker) AS first, max(ticker) AS last, min(low) AS start, CAST(max(high) + INTERVAL 1 DAY AS DATE) AS "end" FROM b GROUP BY 1""")
def backfill_batches(spark: SparkSession, sf: str) -> DataFrame:
    return health.fetch_batches(_user_report(spark, sf).where("is_whole_day_gap"))


@query("""
    WITH t AS (SELECT CAST(user_id AS VARCHAR) AS ticker, count(*) AS n_bars, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1),
    u AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CASE WHEN min(value) < 0.5 THEN 'timeout' END AS error FROM events GROUP BY user_id UNION ALL SELECT 'GONE', NULL)
    SELECT ticker, CASE WHEN error IS NOT NULL THEN 'error' WHEN n_bars IS NULL THEN 'not_found' ELSE 'done' END AS status, coalesce(n_bars, 0) AS n_bars, first, last, error FROM u LEFT JOIN t USING (ticker)
""")
def backfill_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All users, those with a tiny value as failures, and one ticker without bars."""
    ev = views.events(spark, sf)
    got = ev.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").alias("datetime"))
    tried = ev.groupBy(F.col("user_id").cast("string").alias("ticker")).agg(F.when(F.min("value") < 0.5, "timeout").alias("error"))
    tried = tried.unionByName(spark.sql("select 'GONE' ticker, cast(null as string) error"))
    return screening.ledger_rows(got, tried, F.lit(None).cast("timestamp")).drop("fetched_at")


@query(f"SELECT status, count(*) AS n FROM ({ORACLE_SQL['backfill_ledger']}) GROUP BY 1")
def ledger_status(spark: SparkSession, sf: str) -> DataFrame:
    return screening.ledger_counts(backfill_ledger(spark, sf))


@query(f"SELECT ticker FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker FROM events UNION ALL SELECT 'GONE' UNION ALL SELECT 'NEW') WHERE ticker NOT IN (SELECT ticker FROM ({ORACLE_SQL['backfill_ledger']}) WHERE status = 'done')")
def backfill_pending(spark: SparkSession, sf: str) -> DataFrame:
    universe = views.events(spark, sf).select(F.col("user_id").cast("string").alias("ticker")).distinct().unionByName(spark.sql("select * from values ('GONE'), ('NEW') t(ticker)"))
    return screening.not_done(universe, backfill_ledger(spark, sf))


# Sessions and half days by public rules, for three years.
@query("SELECT * FROM (VALUES (2023, CAST(250 AS BIGINT), CAST(2 AS BIGINT)), (2024, 252, 3), (2025, 250, 3), (2026, 251, 2)) t(year, sessions, half_days)")
def trading_sessions(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    cal = calendars.exchange_calendar(spark, dt.date(2023, 1, 1), dt.date(2026, 12, 31))
    length = numbers.minutes_between(F.col("market_open"), F.col("market_close"))
    return cal.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(length == 210).alias("half_days"))


# Keyed tables

@query("""
    WITH e AS (SELECT user_id, event_type, ts, event_id, value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS src FROM events)
    SELECT user_id, event_type, ts, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY src DESC, ts DESC, event_id DESC) = 1
""")
def upsert_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    mid = F.to_timestamp_ntz(F.lit("2024-01-16"))
    return upsert.upsert(ev.where(F.col("ts") < mid), ev.where(F.col("ts") >= mid), ["user_id", "event_type"], ["ts", "event_id"])


RANKED = "SELECT CAST(ts AS DATE) AS date, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rank FROM events"


def _ranked(spark: SparkSession, sf: str, n: int) -> DataFrame:
    w = W.partitionBy("date").orderBy(F.col("value").desc(), "event_id")
    return views.events(spark, sf).select(F.to_date("ts").alias("date"), "event_id", "value").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


@query(f"""
    WITH old AS (SELECT * FROM ({RANKED}) WHERE rank <= 5 AND date < DATE '2024-01-20'), new AS (SELECT date, -event_id AS event_id, value, rank FROM ({RANKED}) WHERE rank <= 3 AND date >= DATE '2024-01-18')
    SELECT * FROM old WHERE (date, rank) NOT IN (SELECT (date, rank) FROM new) UNION ALL SELECT * FROM new
""")
def snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    old = _ranked(spark, sf, 5).where(F.col("date") < F.lit("2024-01-20").cast("date"))
    new = _ranked(spark, sf, 3).where(F.col("date") >= F.lit("2024-01-18").cast("date")).withColumn("event_id", -F.col("event_id"))
    return upsert.snapshot_replace(old, new, ["date", "rank"])


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.keep_first(views.events(spark, sf).select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2")
def upsert_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return upsert.keep_last(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("""
    WITH e AS (SELECT event_type, ts, value FROM events) SELECT event_type, ts, value FROM e WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-16'
    UNION ALL SELECT event_type, ts, value FROM e WHERE ts >= TIMESTAMP '2024-01-16'
""")
def promote_staging(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf).select("event_type", "ts", "value")
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    return upsert.promote(ev.where(F.col("ts") < at("2024-01-16")), ev.where(F.col("ts") >= at("2024-01-16")), F.col("event_type") == "click")


@query("""
    WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
    SELECT user_id, 'add' AS change FROM a WHERE user_id NOT IN (FROM b) UNION ALL SELECT user_id, 'remove' FROM b WHERE user_id NOT IN (FROM a)
""")
def subscription_diff(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf)
    return upsert.changes(ev.where("event_type = 'click'").select("user_id"), ev.where("event_type = 'signup'").select("user_id"), "user_id")


# Allocation

SIGNALS = """
    WITH d AS (SELECT CAST(ts AS DATE) AS ts, event_type AS asset, round(avg(value) - 50, 6) AS signal FROM events GROUP BY 1, 2),
    p AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) AS INTEGER) AS asset_pos FROM (SELECT DISTINCT asset FROM d)),
    s AS (SELECT ts, asset, asset_pos, signal FROM d JOIN p USING (asset))
"""


def alloc_sql(method: str, top_k: int | None, long_only: bool) -> str:
    """The weights of one setting, from ``s``."""
    size = "CASE WHEN signal > 0 THEN signal END" if long_only else "CASE WHEN signal <> 0 THEN abs(signal) END"
    raw = {"equal": "1E0", "signal": "e", "rank": "CAST(row_number() OVER (PARTITION BY ts ORDER BY e ASC NULLS LAST, asset_pos) AS DOUBLE)", "inverse_rank": "1E0 / place"}[method]
    return f"""
        SELECT '{method}' AS method, CAST({top_k or 'NULL'} AS INTEGER) AS top_k, ts, asset, asset_pos,
            round(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY ts), 0), 0) * {'1' if long_only else 'sign(signal)'}, 6) + 0 AS weight
        FROM (SELECT *, CASE WHEN e IS NULL THEN 0E0 ELSE {raw} END AS raw FROM (
            SELECT * REPLACE (CASE WHEN {'place <= ' + str(top_k) if top_k else 'true'} THEN e END AS e) FROM (
                SELECT *, row_number() OVER (PARTITION BY ts ORDER BY e DESC NULLS LAST, asset_pos) AS place FROM (SELECT *, {size} AS e FROM s))))
    """


def _alloc(spark: SparkSession, sf: str, method, top_k, long_only: bool) -> DataFrame:
    out = rounded(allocation.allocate(views.signals(spark, sf), allocation.parameters(spark, method, top_k), long_only=long_only))
    return out.withColumn("weight", F.col("weight") + 0.0)  # no negative zero


for _method in allocation.METHODS:
    for _k in (None, 2):
        for _long in (True, False):
            _name = f"alloc_{_method}" + ("_top2" if _k else "") + ("" if _long else "_long_short")
            QUERIES[_name] = lambda spark, sf, m=_method, k=_k, lo=_long: _alloc(spark, sf, m, k, lo)
            ORACLE_SQL[_name] = SIGNALS + alloc_sql(_method, _k, _long)


@query(SIGNALS + " UNION ALL ".join(alloc_sql(m, k, True) for m in ("equal", "rank", "signal") for k in (1, 3, None)))
def alloc_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _alloc(spark, sf, ["equal", "rank", "signal"], [1, 3, None], True)


@query(f"""{SIGNALS}, w AS ({alloc_sql('signal', None, True)}), r AS (SELECT ts, asset, weight, row_number() OVER (PARTITION BY ts ORDER BY weight DESC, asset_pos) AS i FROM w WHERE weight > 0),
    c AS (SELECT ts, i, asset || ' (' || printf('%.1f', round_even(weight * 100, 1)) || '%)' AS cell FROM r)
    SELECT ts, {', '.join(f'max(CASE WHEN i = {i} THEN cell END) AS "{i}"' for i in (1, 2, 3))} FROM (SELECT DISTINCT ts FROM w) LEFT JOIN c USING (ts) GROUP BY 1""")
def compact_view(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.compact_view(_alloc(spark, sf, "signal", None, True), 3)


# Indicators and decisions

def cross_sql(source: str, fast: int, slow: int) -> str:
    over = "OVER (PARTITION BY ticker ORDER BY datetime ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    avg = lambda n: f"CASE WHEN count(close) {over.format(n - 1)} = {n} THEN avg(close) {over.format(n - 1)} END"
    return f"""
        WITH b AS ({source}), m AS (SELECT *, {avg(fast)} AS fast, {avg(slow)} AS slow FROM b),
        l AS (SELECT *, lag(fast) OVER w AS f0, lag(slow) OVER w AS s0 FROM m WINDOW w AS (PARTITION BY ticker ORDER BY datetime))
        SELECT ticker, datetime, open, high, low, close, volume, round(fast, 6) AS fast, round(slow, 6) AS slow,
            CASE WHEN f0 <= s0 AND fast > slow THEN 'above' WHEN f0 >= s0 AND fast < slow THEN 'below' END AS "cross" FROM l
    """


@query(cross_sql(HOURLY, 10, 30))
def sma_cross(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.crossovers(views.hourly(spark, sf)))


LAST_CROSS = f"""SELECT * FROM ({cross_sql(DAILY, 3, 8)}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY datetime DESC) = 1"""
HELD = "SELECT CAST(range AS VARCHAR) AS symbol FROM range(0, 10)"


DECIDED = """
    WITH x AS (SELECT ticker AS symbol, "cross" AS c FROM (LAST_CROSS)), h AS (HELD),
    d AS (SELECT 'open' AS kind, symbol, 'buy' AS side, 0.1E0 AS weight FROM x WHERE c = 'above' AND symbol NOT IN (FROM h) UNION ALL SELECT 'close', symbol, NULL, NULL FROM x WHERE c = 'below' AND symbol IN (FROM h))
    SELECT CAST(row_number() OVER (ORDER BY CASE kind WHEN 'open' THEN 0 ELSE 1 END, symbol) AS INTEGER) AS seq, kind, symbol, side, weight FROM d
""".replace("LAST_CROSS", LAST_CROSS)
POLLED = DECIDED.replace("(HELD)", "(SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol FROM events WHERE user_id % 2 = 0)")


@query(DECIDED.replace("(HELD)", f"({HELD})"))
def sma_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.sma_cross_strategy(3, 8)(views.daily_by_user(spark, sf), views.holdings(spark))


MOMENTUM = f"""
    r AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY datetime DESC) AS rn FROM ({DAILY})),
    m AS (SELECT ticker AS asset, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 5) - 1 AS signal FROM r WHERE rn <= 5 GROUP BY 1 HAVING count(*) = 5),
    s AS (SELECT 0 AS ts, asset, row_number() OVER (ORDER BY asset) AS asset_pos, signal FROM m),
    t AS (SELECT asset AS symbol, weight FROM ({alloc_sql('rank', 20, True)}) WHERE weight <> 0)
"""


@query(f"WITH {MOMENTUM} SELECT symbol, weight FROM t")
def momentum_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decisions.momentum_targets(views.daily_by_user(spark, sf), 5, 20))


REBALANCED = f"""
    h AS ({HELD}),
    d AS (SELECT 'open' AS kind, symbol, CASE WHEN weight > 0 THEN 'buy' ELSE 'sell' END AS side, abs(weight) AS weight FROM t WHERE symbol NOT IN (FROM h) UNION ALL SELECT 'close', symbol, NULL, NULL FROM h WHERE symbol NOT IN (SELECT symbol FROM t)),
    n AS (SELECT CAST(row_number() OVER (ORDER BY CASE kind WHEN 'open' THEN 0 ELSE 1 END, symbol) AS INTEGER) AS seq, kind, symbol, side, weight FROM d)
"""


@query(f"WITH {MOMENTUM}, {REBALANCED} SELECT * FROM n")
def rebalance_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decisions.momentum_strategy(5, 20)(views.daily_by_user(spark, sf), views.holdings(spark)))


@query(f"""WITH {MOMENTUM}, {REBALANCED}, p AS (SELECT CAST(user_id AS VARCHAR) AS symbol, max_by(value, (ts, event_id)) AS price FROM events GROUP BY 1)
    SELECT symbol, kind, side, round(CASE WHEN kind = 'open' THEN weight * 100000E0 / price END, 4) AS qty, CASE WHEN kind = 'close' THEN 100E0 END AS close_percent FROM n LEFT JOIN p USING (symbol)""")
def order_sizing(spark: SparkSession, sf: str) -> DataFrame:
    prices = orderbook.latest(views.events(spark, sf).withColumn("symbol", F.col("user_id").cast("string")), "symbol", ["ts", "event_id"], ["value"]).select("symbol", F.col("value").alias("price"))
    decided = rebalance_decisions(spark, sf).withColumns({"qty": F.lit(None).cast("double"), "fraction": F.lit(None).cast("double")})
    return rounded(decisions.order_requests(decided, prices, 100_000.0), 4)


# Screening and reference data

@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def screen_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal >= 0").select("c_custkey", "c_name", "c_acctbal")
    return screening.top(c, "c_acctbal", 50, "c_custkey")


@query("""
    WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
    SELECT o_orderkey, o_custkey, c_mktsegment FROM t LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'
""")
def screen_exclude_quote(spark: SparkSession, sf: str) -> DataFrame:
    top = screening.top(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 50, "o_orderkey")
    quotes = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return screening.exclude_quote(top, quotes, "o_custkey", "c_mktsegment", "BUILDING").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""
    WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY pos <= 40),
    b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer QUALIFY pos <= 100),
    u AS (SELECT c_custkey, 0 AS src, pos FROM a UNION ALL SELECT c_custkey, 1, pos FROM b)
    SELECT c_custkey, src, pos FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src, pos) = 1
""")
def universe_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")

    def listed(df: DataFrame, n: int) -> DataFrame:
        top = screening.top(df, "c_acctbal", n, "c_custkey")
        return top.withColumn("pos", F.row_number().over(W.orderBy(F.col("c_acctbal").desc(), "c_custkey")).cast("long"))

    return upsert.ordered_union([listed(c.where("c_mktsegment = 'BUILDING'"), 40), listed(c, 100)], "c_custkey", "pos")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def anti_universe(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return screening.not_etfs(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), held, "c_nationkey").select("c_custkey")


SYMBOLS = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'AB' || c_nationkey || 'USDT' WHEN 1 THEN 'S' || 'ETH' WHEN 2 THEN 'XX' || 'BTC' WHEN 3 THEN 'BF-A' WHEN 4 THEN 'SHIBUSD' ELSE 'N' || c_nationkey || '-USD' END AS symbol FROM customer"""


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 6
    symbol = (
        F.when(k == 0, F.concat(F.lit("AB"), F.col("c_nationkey").cast("string"), F.lit("USDT"))).when(k == 1, "SETH").when(k == 2, "XXBTC").when(k == 3, "BF-A").when(k == 4, "SHIBUSD")
        .otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("-USD")))
    )
    return c.select("c_custkey", symbol.alias("symbol"))


@query(f"SELECT c_custkey, symbol, CASE WHEN regexp_matches(symbol, '^.{{2,}}(USDT|BUSD|BTC|ETH|BNB)$') THEN 'cryptos' ELSE 'equities' END AS asset_class FROM ({SYMBOLS})")
def symbol_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).withColumn("asset_class", text.asset_class(F.col("symbol")))


@query(rf"SELECT c_custkey, regexp_replace(symbol, '^([A-Z0-9]+)-([A-Z]{{1,2}})$', '\1.\2') AS dotted, upper(trim(replace(lower(symbol) || '.b ', '.', '-'))) AS dashed FROM ({SYMBOLS})")
def symbol_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("c_custkey", text.dotted(F.col("symbol")).alias("dotted"), text.dashed(F.concat(F.lower("symbol"), F.lit(".b "))).alias("dashed"))


@query(f"SELECT c_custkey, regexp_replace(symbol, '(USDT|BUSD|BTC|ETH|BNB)$', '') AS base FROM ({SYMBOLS})")
def base_asset(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("c_custkey", text.base_asset(F.col("symbol")).alias("base"))


@query("""
    SELECT n_name AS base, CAST(s_suppkey AS VARCHAR) AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey
    QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE nullif(abs(s_acctbal), 0) END ASC NULLS LAST, s_suppkey) = 1
""")
def resolve_ids(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("base"))
    rank = F.when(F.col("s_suppkey") % 3 != 0, F.abs("s_acctbal"))
    cand = table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("base", F.col("s_suppkey").cast("string").alias("id"), rank.alias("rank"), F.col("s_suppkey").alias("src_pos"))
    return screening.resolve_ids(nations.select("base"), cand)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("""
    WITH s AS (SELECT s_nationkey AS ticker, min(s_name) AS name, 'suppliers' AS source FROM supplier GROUP BY 1),
    c AS (SELECT c_nationkey AS ticker, coalesce(nullif(min(CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_name END), ''), min(c_mktsegment)) AS name, 'customers' AS source FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1)
    SELECT * FROM c UNION ALL SELECT * FROM s WHERE ticker NOT IN (SELECT ticker FROM c)
""")
def metadata_union(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("ticker")).agg(F.min("s_name").alias("name")).withColumn("source", F.lit("suppliers"))
    c = table(spark, sf, "customer").where("c_nationkey is not null").groupBy(F.col("c_nationkey").alias("ticker"))
    c = c.agg(F.min(F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_name"))).alias("long"), F.min("c_mktsegment").alias("short"))
    c = c.select("ticker", text.or_else(F.col("long"), F.col("short")).alias("name"), F.lit("customers").alias("source"))
    return screening.consolidated_metadata([s, c])


@query("""
    WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '+$' || printf('%.2f', value) || 'k' WHEN 1 THEN '-' || printf('%.2f', value) || '%' WHEN 2 THEN '×' || CAST(user_id AS VARCHAR) WHEN 3 THEN '1,' || printf('%03d', user_id) WHEN 4 THEN printf('%.2f', value) || 'B' ELSE '5d' END AS raw,
        CASE event_id % 6 WHEN 0 THEN CAST(printf('%.2f', value) AS DOUBLE) * 1000 WHEN 1 THEN -CAST(printf('%.2f', value) AS DOUBLE) WHEN 2 THEN CAST(user_id AS DOUBLE) WHEN 3 THEN 1000E0 + user_id END AS number FROM events)
    SELECT event_id, raw, round(number, 6) AS number FROM e
""")
def parse_num(spark: SparkSession, sf: str) -> DataFrame:
    k, one = F.col("event_id") % 6, F.format_string("%.2f", "value")
    cases = [(0, F.concat(F.lit("+$"), one, F.lit("k"))), (1, F.concat(F.lit("-"), F.format_string("%.2f", "value"), F.lit("%"))), (2, F.concat(F.lit("×"), F.col("user_id").cast("string"))), (3, F.concat(F.lit("1,"), F.format_string("%03d", "user_id"))), (4, F.concat(one, F.lit("B")))]
    raw = F.lit("5d")
    for i, c in cases:
        raw = F.when(k == i, c).otherwise(raw)
    return rounded(views.events(spark, sf).select("event_id", raw.alias("raw")).withColumn("number", text.number(F.col("raw"))))


@query("""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\x0B\\f\\r\\x85\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')), lambda x: x <> '') AS a FROM documents)
    SELECT doc_id, i + 1 AS group_no, a[i * 3 + 1] AS a, a[i * 3 + 2] AS b, a[i * 3 + 3] AS c FROM l, unnest(range(0, len(a) // 3)) t(i)
""")
def line_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return docs.select("doc_id", F.posexplode(text.chunks(F.col("l"), 3, ["a", "b", "c"])).alias("i", "r")).select("doc_id", (F.col("i") + 1).cast("long").alias("group_no"), "r.*")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Captured texts made of events: three panels for each hour."""
    w = W.partitionBy("h").orderBy("ts", "event_id")
    ev = views.events(spark, sf).withColumn("h", F.date_trunc("hour", "ts")).withColumn("i", F.row_number().over(w))
    line = F.concat_ws("\n", F.upper("event_type"), F.format_string("$%.2f", "value"), F.format_string("-%d%%", "user_id"))
    trade = F.concat_ws("\n", F.upper("event_type"), F.when(F.col("i") % 2 == 0, F.lit("$400C 8/15")), F.format_string("×%d", "user_id"), F.format_string("+$%.2fk", "value"))
    rows = ev.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line"), trade.alias("trade")))).alias("r"))
    body = F.concat_ws("\n", F.lit("Closed\nMe"), F.transform("r", lambda x: x["line"]), F.lit("TOP TRADES\nTABLE"), F.transform("r", lambda x: x["trade"]), F.lit("CONNECT & VERIFY\nSENTIMENT"))
    return rows.select(F.col("h").alias("capture_ts"), F.lit("base").alias("view"), body.alias("text"))


@query("""
    SELECT date_trunc('hour', ts) AS date, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS rank, upper(event_type) AS ticker,
        CASE WHEN row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) % 2 = 0 THEN '$400C 8/15' END AS contract, CAST(user_id AS DOUBLE) AS qty, round(CAST(printf('%.2f', value) AS DOUBLE) * 1000, 6) AS pnl FROM events
""")
def top_trades(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = panels.tables(panels.extract(_panel(spark, sf)))["panel_top_trades"]
    return rounded(rows.select("date", F.col("rank").cast("long").alias("rank"), "ticker", "contract", "qty", "pnl"))


@query("""
    WITH e AS (SELECT date_trunc('hour', ts) AS h, upper(event_type) AS t, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS i, user_id FROM events),
    f AS (SELECT h, i, t, user_id, (SELECT min(x.i) FROM e x WHERE x.h = e.h AND regexp_matches(x.t, '^[A-Z]{1,5}$')) AS first FROM e)
    SELECT h AS date, row_number() OVER (PARTITION BY h ORDER BY i) AS rank, t AS ticker, -CAST(user_id AS DOUBLE) AS change_pct FROM (SELECT * FROM f WHERE i >= first QUALIFY row_number() OVER (PARTITION BY h, t ORDER BY i) = 1)
""")
def panel_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = panels.tables(panels.extract(_panel(spark, sf)))["panel_biggest_movers"]
    return rows.select("date", F.col("rank").cast("long").alias("rank"), "ticker", "change_pct")


# Order books

def bucket_sql(source: str) -> str:
    return f"""
        WITH l AS ({source}), s AS (SELECT ticker, date, count(*) AS n, min(price) AS lo, max(price) AS hi, CASE WHEN max(price) > min(price) THEN (max(price) - min(price)) / 10 ELSE 1E0 END AS w FROM l GROUP BY 1, 2),
        b AS (SELECT ticker, date, least(CAST(floor((price - lo) / w) AS INTEGER), 9) AS level, sum(size) AS size FROM l JOIN s USING (ticker, date) WHERE n > 10 GROUP BY 1, 2, 3)
        SELECT ticker, date, CAST(pos AS INTEGER) AS level, round(price, 6) AS price, round(size, 6) AS size FROM l JOIN s USING (ticker, date) WHERE n <= 10
        UNION ALL SELECT s.ticker, s.date, CAST(i AS INTEGER), round(lo + (i + 0.5E0) * w, 6), round(coalesce(size, 0), 6) FROM s CROSS JOIN range(0, 10) t(i) LEFT JOIN b ON b.ticker = s.ticker AND b.date = s.date AND b.level = t.i WHERE n > 10
    """


@query(bucket_sql("SELECT CAST(user_id % 40 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, value AS price, CAST(event_id % 7 AS DOUBLE) AS size, row_number() OVER (PARTITION BY user_id % 40, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS pos FROM events"))
def book_bucket(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("ticker", "date").orderBy("ts", "event_id")
    ev = views.events(spark, sf).select((F.col("user_id") % 40).cast("string").alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", F.col("value").alias("price"), (F.col("event_id") % 7).cast("double").alias("size"))
    levels = ev.withColumn("pos", F.row_number().over(w) - 1)
    return rounded(orderbook.bucket_levels(levels, ["ticker", "date"]))


SIDES = "CASE WHEN event_type IN ('click', 'view') THEN 'bid' ELSE 'ask' END"
BOOKS = f"SELECT CAST(user_id % 40 AS VARCHAR) || ' ' || {SIDES} AS ticker, date_trunc('day', ts) AS date, value AS price, CAST(event_id % 7 AS DOUBLE) AS size, row_number() OVER (PARTITION BY user_id % 40, {SIDES}, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS pos FROM events"


@query(f"SELECT date AS timestamp, split_part(ticker, ' ', 1) AS ticker, split_part(ticker, ' ', 2) AS side, level, price, size FROM ({bucket_sql(BOOKS)})")
def book_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows of pushed books, each bucketed within its own row; here a book is a day's events."""
    ev = views.events(spark, sf)
    level = F.struct("ts", "event_id", F.col("value").alias("price"), (F.col("event_id") % 7).cast("double").alias("size"))
    side = lambda kept: F.transform(F.sort_array(F.collect_list(F.when(kept, level))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    bid = F.col("event_type").isin("click", "view")
    books = ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 40).cast("string").alias("code")).agg(side(bid).alias("bids"), side(~bid).alias("asks"))
    return rounded(orderbook.snapshots(books))


@query("SELECT user_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_book(spark: SparkSession, sf: str) -> DataFrame:
    return orderbook.latest(views.events(spark, sf), "user_id", ["ts", "event_id"], ["ts", "value"])


@query("""
    WITH t AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS ts),
    b AS (SELECT event_type, ts, value AS v, 0 AS tick FROM events UNION ALL SELECT event_type, ts, NULL, 1 FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN t),
    h AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, tick ROWS UNBOUNDED PRECEDING) AS value FROM b)
    SELECT event_type, ts, value FROM h WHERE tick = 1 AND value IS NOT NULL
""")
def sample_hold(spark: SparkSession, sf: str) -> DataFrame:
    ev = views.events(spark, sf)
    span = ev.agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b"))
    ticks = span.select(F.explode(F.sequence(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"), F.expr("interval 1 hour"))).alias("ts"))
    return orderbook.sample_hold(ev, ticks, "event_type", "ts", "value", every_seconds=3600)


@query("SELECT 'hourly' AS name, true AS stale UNION ALL SELECT 'daily', true UNION ALL SELECT 'fresh', false UNION ALL SELECT 'never', true")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    control = spark.sql("select * from values ('hourly', timestamp '2024-01-01 00:00:00'), ('daily', timestamp '2024-01-30 23:59:00'), ('fresh', timestamp '2024-01-31 00:00:00') t(name, written_at)")
    names = spark.sql("select * from values ('hourly'), ('daily'), ('fresh'), ('never') t(name)")
    return files.stale(control, names, F.lit("2024-01-31 00:01:00").cast("timestamp"), freq="daily")

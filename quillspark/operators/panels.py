"""Captured panel texts to history tables, with array expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import SENTIMENT, TICKER, chunks, lines, number, streak_days

# What panels print.
HEADERS = ["MENTIONS 24H", "SENTIMENT", "LEADERBOARD", "TOP HOLDINGS", "TOP TRADES"]
END = "CONNECT & VERIFY"
JUNK = ["TABLE", "CHART", "COMMENTS", "STREAKS", "·"]
# Names of recurring threads.
THREADS = {"moves": "What Are Your Moves", "daily": "Daily Discussion", "weekend": "Weekend Discussion", "any": ""}

_NONE = "array<string>"


def sections(captures: DataFrame, text: str = "text") -> DataFrame:
    """``captures`` with strip (the lines of the ticker strip) and blocks, a map of the lines below each header.

    Headers count only before the end marker; of a header that repeats the last
    one counts; junk lines are dropped from blocks, not from the strip.
    """
    at = captures.withColumn("l", F.coalesce(lines(F.col(text)), F.array().cast(_NONE)))
    size = F.size("l")
    end = F.when(F.array_contains("l", END), F.array_position("l", END).cast("int") - 1).otherwise(size)
    at = at.withColumn("stop", end)
    before = F.when(F.col("stop") > 0, F.sequence(F.lit(0), F.col("stop") - 1)).otherwise(F.array().cast("array<int>"))
    at = at.withColumn("heads", F.filter(before, lambda i: F.get("l", i).isin(HEADERS)))
    first = F.coalesce(F.get("heads", F.lit(0)), size)
    leading = F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(F.array().cast("array<int>"))
    start = F.coalesce(F.get(F.filter(leading, lambda i: F.get("l", i).rlike(TICKER)), F.lit(0)), first)
    blocks = [F.lit(h) for h in HEADERS]
    made: list[Column] = []
    for head in blocks:
        made += [head, _below(head)]
    kept = F.map_filter(F.create_map(*made), lambda _, v: v.isNotNull())
    return at.select(*captures.columns, F.slice("l", start + 1, first - start).alias("strip"), kept.alias("blocks"))


def _below(head: Column) -> Column:
    """The lines from the last occurrence of a header to the next one, of a row with l, heads and stop."""
    place = F.array_max(F.filter("heads", lambda i: F.get("l", i) == head))
    stop = F.coalesce(F.array_min(F.filter("heads", lambda i: i > place)), F.col("stop"))
    return F.filter(F.slice("l", place + 2, F.greatest(stop - place - 1, F.lit(0))), lambda x: ~x.isin(JUNK))


def ticker_groups(items: Column, columns: int) -> Column:
    """Structs of ticker, price, change_pct and, of four columns, count."""
    names = ["ticker", "price", "change_pct", "count"][:columns]
    return F.transform(chunks(items, columns, names), lambda r: F.struct(r["ticker"].alias("ticker"), *(number(r[n]).alias(n) for n in names[1:])))


def movers(strip: Column) -> Column:
    """Ticker groups of three, the first of each ticker.

    Groups are sorted by ticker and place, those that follow one of their ticker go, and the rest goes back in order of place.
    """
    placed = F.array_sort(F.transform(ticker_groups(strip, 3), lambda r, i: F.struct(r["ticker"].alias("ticker"), i.alias("at"), r.alias("row"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda r: r["ticker"]))
    # the list of tickers is one longer than the groups: the last pair has no group
    firsts = F.zip_with(placed, before, lambda r, last: F.when(r["ticker"].isNotNull() & ~r["ticker"].eqNullSafe(last), F.struct(r["at"].alias("at"), r["row"].alias("row"))))
    return F.transform(F.array_sort(F.filter(firsts, lambda r: r.isNotNull())), lambda r: r["row"])


def sentiment_state(items: Column) -> Column:
    """Struct of pct, label and tickers (ticker, split, pct)."""
    head = F.get(items, F.lit(0))
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    rows = F.transform(chunks(rest, 3, ["ticker", "split", "pct"]), lambda r: F.struct(r["ticker"].alias("ticker"), r["split"].alias("split"), number(r["pct"]).alias("pct")))
    part = lambda i: F.nullif(F.regexp_extract(head, SENTIMENT, i), F.lit(""))
    return F.struct(part(1).cast("double").alias("pct"), part(2).alias("label"), rows.alias("tickers"))


def sentiment(base: Column, other: Column) -> Column:
    """Both directions by their labels, whichever state was the first one; of equal labels the second state counts."""
    states = (sentiment_state(other), sentiment_state(base))
    pick = lambda label, field: F.coalesce(*(F.when(s["label"] == label, s[field]) for s in states))
    none = F.expr("cast(array() as array<struct<ticker:string,split:string,pct:double>>)")
    return F.struct(
        pick("Bear", "pct").alias("bearish_pct"), pick("Bull", "pct").alias("bullish_pct"),
        F.coalesce(pick("Bear", "tickers"), none).alias("most_bearish"), F.coalesce(pick("Bull", "tickers"), none).alias("most_bullish"),
    )


def leaderboard(items: Column, streaks: bool = False) -> Column:
    value, parse = ("streak_days", streak_days) if streaks else ("count", number)
    return F.transform(chunks(items, 2, ["username", "v"]), lambda r: F.struct(r["username"].alias("username"), parse(r["v"]).alias(value)))


def top_trades(items: Column) -> Column:
    """Records of ticker, [contract unless the line is a quantity], qty, pnl; a record that is cut off is dropped.

    The lines are joined and matched record after record in one pass: where the second line is no quantity, two lines follow it.
    """
    line = r"[^\n]*\n"
    record = rf"\G{line}(?:(?!×){line}{line}|(?=×){line}){line}"
    text = F.array_join(F.transform(F.coalesce(items, F.array().cast(_NONE)), lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit("\n"))), "")

    def fields(part: Column) -> Column:
        last = F.size(part) - 2  # the last part is what follows the last line
        return F.struct(
            F.get(part, F.lit(0)).alias("ticker"), F.when(last == 3, F.get(part, F.lit(1))).alias("contract"),
            number(F.get(part, last - 1)).alias("qty"), number(F.get(part, last)).alias("pnl"),
        )

    records = F.transform(F.regexp_extract_all(text, F.lit(record), F.lit(0)), lambda r: F.split(r, "\n"))
    return F.transform(records, fields)


def extract(captures: DataFrame) -> DataFrame:
    """One row for each hour of capture with all panels; ``captures`` has capture_ts, view and text.

    Views are ``base``, ``leaderboard_alt`` and ``sentiment_alt``; a view that is missing is empty.
    """
    split = sections(captures).groupBy("capture_ts").pivot("view", ["base", "leaderboard_alt", "sentiment_alt"]).agg(F.first(F.struct("strip", "blocks")))
    block = lambda view, head: F.coalesce(F.element_at(F.col(f"{view}.blocks"), head), F.array().cast(_NONE))
    return split.select(
        "capture_ts", movers(F.coalesce(F.col("base.strip"), F.array().cast(_NONE))).alias("biggest_movers"), ticker_groups(block("base", "MENTIONS 24H"), 4).alias("mentions"),
        sentiment(block("base", "SENTIMENT"), block("sentiment_alt", "SENTIMENT")).alias("sentiment"), leaderboard(block("base", "LEADERBOARD")).alias("leaderboard"),
        leaderboard(block("leaderboard_alt", "LEADERBOARD"), streaks=True).alias("leaderboard_streaks"), ticker_groups(block("base", "TOP HOLDINGS"), 4).alias("top_holdings"),
        top_trades(block("base", "TOP TRADES")).alias("top_trades"),
    )


def tables(extracted: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Each history table's new rows and its key: ranks from 1, dates cut to the hour of capture; blank tickers are no mentions."""
    hour = F.date_trunc("hour", "capture_ts").cast("timestamp_ntz").alias("date")
    one = extracted.select(hour, "sentiment.bearish_pct", "sentiment.bullish_pct")
    out = {"panel_sentiment": (one, ["date"])}
    for name, source in {
        "panel_sentiment_most_bearish": "sentiment.most_bearish", "panel_sentiment_most_bullish": "sentiment.most_bullish", "panel_top_holdings": "top_holdings", "panel_top_trades": "top_trades",
        "panel_biggest_movers": "biggest_movers", "panel_leaderboard": "leaderboard", "panel_leaderboard_streaks": "leaderboard_streaks", "panel_mentions": "mentions",
    }.items():
        rows = extracted.select(hour, F.posexplode(source).alias("pos", "r")).select("date", (F.col("pos") + 1).alias("rank"), "r.*")
        out[name] = (rows.where("ticker <> ''"), ["date", "ticker"]) if name == "panel_mentions" else (rows, ["date", "rank"])
    return out


def pick_post(posts: DataFrame, wanted: str) -> DataFrame:
    """The newest post whose title holds the thread's name or the given words, in any case; of no words, the newest one."""
    words = THREADS.get(wanted, wanted)
    return posts.where(F.contains(F.lower("title"), F.lower(F.lit(words)))).orderBy(F.col("created_utc").desc(), "id").limit(1)


def require_post(posts: DataFrame, wanted: str, most: int = 20) -> DataFrame:
    """``pick_post``, or an error that lists the newest titles."""
    picked = pick_post(posts, wanted)
    if picked.isEmpty():
        titles = [r["title"] for r in posts.orderBy(F.col("created_utc").desc(), "id").limit(most).collect()]
        raise LookupError(f"no post titled {THREADS.get(wanted, wanted)!r}; there are: {'; '.join(titles)}")
    return picked


def parse_listing(listing: DataFrame, now: Column, site: str, body: str = "body") -> DataFrame:
    """(id, title, url, created_utc) of listing JSON; a missing time is ``now``."""
    schema = "data struct<children:array<struct<data:struct<id:string,title:string,permalink:string,created_utc:double>>>>"
    each = listing.select(F.explode(F.from_json(body, schema)["data"]["children"]).alias("c")).select("c.data.*")
    url = F.when(F.coalesce("permalink", F.lit("")) == "", "").otherwise(F.concat(F.lit(site), "permalink"))
    return each.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), url.alias("url"), F.coalesce(F.timestamp_seconds(F.nullif("created_utc", F.lit(0.0))), now).alias("created_utc"))


def first_by_ticker(rows: DataFrame) -> DataFrame:
    """Of rows (ticker, pos) the first of each ticker, in order."""
    w = W.partitionBy("ticker").orderBy("pos")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

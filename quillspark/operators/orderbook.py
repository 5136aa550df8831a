"""Order books: latest state, depth bucketing, sample and hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 10


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def bucket_levels(levels: DataFrame, keys: list[str], n: int = LEVELS) -> DataFrame:
    """(keys, level, price, size): sides of up to ``n`` levels as they are, larger ones as ``n`` equal-width price bins.

    ``levels`` has keys, pos, price and size. A bin has its mid price and the sum
    of its sizes; empty bins are there with size 0; the top price is in the last bin.
    """
    side = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("price").alias("low"), F.max("price").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / n).otherwise(1.0)
    rows = levels.join(side.withColumn("width", width), keys)
    thin = rows.where(F.col("count") <= n).select(*keys, F.col("pos").cast("int").alias("level"), "price", "size")
    level = F.least(F.floor((F.col("price") - F.col("low")) / F.col("width")), F.lit(n - 1)).cast("int")
    sums = rows.where(F.col("count") > n).groupBy(*keys, level.alias("level")).agg(F.sum("size").alias("size"))
    bins = side.where(F.col("count") > n).withColumn("width", width).select(*keys, "low", "width", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"))
    wide = bins.join(sums, [*keys, "level"], "left").select(*keys, "level", (F.col("low") + (F.col("level") + 0.5) * F.col("width")).alias("price"), F.coalesce("size", F.lit(0.0)).alias("size"))
    return thin.unionByName(wide)


def book_levels(books: DataFrame) -> DataFrame:
    """(ts, code, side, pos, price, size) of pushed books (ts, code, bids, asks)."""
    sides = F.array(*(F.struct(F.lit(s[:-1]).alias("side"), F.col(s).alias("levels")) for s in ("bids", "asks")))
    each = books.select("ts", "code", F.explode(sides).alias("s"))
    return each.select("ts", "code", "s.side", F.posexplode("s.levels").alias("pos", "l")).select("ts", "code", "side", "pos", "l.price", "l.size")


def bucketed(levels: Column, n: int = LEVELS) -> Column:
    """``bucket_levels`` of one side within its row: array<struct<level, price, size>> of array<struct<price, size>>."""
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluated once for a side, not again for each of its levels)
    row = lambda level, price, size: F.struct(level.cast("int").alias("level"), price.cast("double").alias("price"), size.cast("double").alias("size"))
    prices = F.transform(levels, lambda x: x["price"])
    ends = F.struct(F.array_min(prices).alias("low"), F.array_max(prices).alias("high"))
    span = lambda e: F.struct(e["low"].alias("low"), F.when(e["high"] > e["low"], (e["high"] - e["low"]) / n).otherwise(1.0).alias("width"))
    placed = lambda s: F.transform(levels, lambda x: F.struct(F.least(F.floor((x["price"] - s["low"]) / s["width"]), F.lit(n - 1)).alias("level"), x["size"].alias("size")))
    total = lambda p, i: F.aggregate(p, F.lit(0.0), lambda sum_, x: sum_ + F.when(x["level"] == i, x["size"]).otherwise(0.0))
    bins = once(once(ends, span), lambda s: once(placed(s), lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: row(i, s["low"] + (i + 0.5) * s["width"], total(p, i)))))
    return F.when(F.size(levels) <= n, F.transform(levels, lambda x, i: row(i, x["price"], x["size"]))).when(F.size(levels) > n, bins)


def snapshots(books: DataFrame, n: int = LEVELS) -> DataFrame:
    """Rows as stored: timestamp, ticker (the prefixed code), side, level, price, size. Each book is bucketed in its row: nothing is shuffled."""
    sides = F.array(*(F.struct(F.lit(s[:-1]).alias("side"), F.col(s).alias("levels")) for s in ("bids", "asks")))
    each = books.select(F.col("ts").alias("timestamp"), F.col("code").alias("ticker"), F.explode(sides).alias("s"))
    each = each.select("timestamp", "ticker", "s.side", F.explode(bucketed(F.col("s.levels"), n)).alias("l"))
    return each.select("timestamp", "ticker", "side", "l.level", "l.price", "l.size")


def prefixed(ticker: Column) -> Column:
    return F.concat(F.lit("US."), ticker)


def sample_hold(events: DataFrame, ticks: DataFrame, key: str, ts: str, value: str, every_seconds: int | None = None) -> DataFrame:
    """(key, ts, value) at each tick: the key's last value at or before it, for every key seen by then.

    Ticks are put among the events of each key and the last value is carried
    forward in one window, so the spine is keys by ticks and nothing is joined on ranges.
    Where ticks are whole multiples of ``every_seconds``, events are first reduced to the last one of each
    key and interval, before any shuffle, so that the window holds ticks and not events.
    """
    if every_seconds is not None:
        kind, step = dict(events.dtypes)[ts], every_seconds * 1_000_000
        tick = F.timestamp_micros(F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / step) * step).cast(kind)
        events = events.where(F.col(value).isNotNull()).groupBy(key, tick.alias("_tick")).agg(F.max_by(value, ts).alias(value)).withColumnRenamed("_tick", ts)
    spine = events.select(key).distinct().crossJoin(F.broadcast(ticks.select(F.col(ticks.columns[0]).alias(ts))))
    both = events.select(key, ts, F.col(value).alias("v"), F.lit(0).alias("tick")).unionByName(spine.select(key, ts, F.lit(None).cast(dict(events.dtypes)[value]).alias("v"), F.lit(1).alias("tick")))
    held = F.last("v", ignorenulls=True).over(W.partitionBy(key).orderBy(ts, "tick").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("held", held).where("tick = 1 and held is not null").select(key, ts, F.col("held").alias(value))


def book_text(levels: DataFrame) -> DataFrame:
    """(ts, code, text): asks from the highest down, then bids."""
    line = F.format_string("%10.2f %8.0f", "price", "size")
    rows = levels.groupBy("ts", "code", "side").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("all"))
    wide = rows.groupBy("ts", "code").pivot("side", ["ask", "bid"]).agg(F.first(F.transform("all", lambda x: x["line"])))
    empty = F.array().cast("array<string>")
    return wide.select("ts", "code", F.array_join(F.concat(F.reverse(F.coalesce("ask", empty)), F.array(F.lit("-" * 19)), F.coalesce("bid", empty)), "\n").alias("text"))

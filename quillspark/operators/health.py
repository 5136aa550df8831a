"""Data health: completeness reports, rollups, and what to fetch again."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.numbers import completeness
from quillspark.operators.numbering import numbered_chunks

REFETCH_BELOW = 0.9


def minute_counts(bars: DataFrame) -> DataFrame:
    """(ticker, date, n): bars of each UTC day."""
    return bars.groupBy("ticker", F.to_date("datetime").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def gap_report(tickers: DataFrame, calendar: DataFrame, counts: DataFrame, threshold: float = REFETCH_BELOW) -> DataFrame:
    """A dense row for each ticker (ticker, asset_class) and valid day of its class (asset_class, date, expected_minutes)."""
    spine = tickers.join(F.broadcast(calendar), "asset_class")
    full = spine.join(counts, ["ticker", "date"], "left").withColumn("actual_minutes", F.coalesce("n", F.lit(0)).cast("long"))
    share = completeness(F.col("actual_minutes"), F.col("expected_minutes"))
    return full.select(
        "ticker", "date", "asset_class", F.col("expected_minutes").cast("long").alias("expected_minutes"), "actual_minutes", share.alias("completeness"),
        (F.col("actual_minutes") == 0).alias("is_whole_day_gap"), (share < threshold).alias("needs_refetch"),
    )


def summarize(report: DataFrame) -> DataFrame:
    """One row for each class: tickers, those with a whole-day gap or a day to fetch again, mean and exact median completeness."""
    by_ticker = report.groupBy("asset_class", "ticker").agg(F.bool_or("is_whole_day_gap").alias("gap"), F.bool_or("needs_refetch").alias("again"))
    flags = by_ticker.groupBy("asset_class").agg(F.count(F.lit(1)).alias("tickers"), F.count_if("gap").alias("with_whole_day_gap"), F.count_if("again").alias("with_refetch"))
    # the median is taken over distinct values with their counts: few rows, whatever the report's size
    values = report.groupBy("asset_class", "completeness").agg(F.count(F.lit(1)).alias("n"))
    stats = values.groupBy("asset_class").agg((F.sum(F.col("completeness") * F.col("n")) / F.sum("n")).alias("mean_completeness"), F.percentile("completeness", 0.5, F.col("n")).alias("median_completeness"))
    return flags.join(stats, "asset_class")


def worst_coverage(report: DataFrame, n: int) -> DataFrame:
    """The ``n`` tickers of least mean completeness, ties by ticker, with their first and last day present."""
    by_ticker = report.groupBy("ticker").agg(
        F.min("asset_class").alias("asset_class"), F.avg("completeness").alias("mean"), F.count_if("is_whole_day_gap").alias("whole_day_gaps"), F.count_if("needs_refetch").alias("refetch_days"),
        F.min(F.when(F.col("actual_minutes") > 0, F.col("date"))).alias("first_date_present"), F.max(F.when(F.col("actual_minutes") > 0, F.col("date"))).alias("last_date_present"),
    )
    top = by_ticker.orderBy(F.round("mean", 9), "ticker").limit(n)  # means that differ by the order of their sums are ties
    return top.select("ticker", "asset_class", F.bround(F.col("mean") * 100, 1).alias("mean_pct"), "whole_day_gaps", "refetch_days", "first_date_present", "last_date_present")


def dead_tickers(report: DataFrame) -> DataFrame:
    """Tickers without any bar."""
    return report.groupBy("ticker").agg(F.min("asset_class").alias("asset_class"), F.avg("completeness").alias("mean")).where("mean = 0").select("ticker", "asset_class")


def heatmap(report: DataFrame, dates: list, n: int | None = None) -> DataFrame:
    """Completeness with a column for each date, the ``n`` tickers of least mean first."""
    means = report.groupBy("ticker").agg(F.avg("completeness").alias("mean"))
    if n is not None:
        means = means.orderBy("mean", "ticker").limit(n)
    names = [str(d) for d in dates]
    wide = report.withColumn("day", F.col("date").cast("string")).groupBy("ticker").pivot("day", names).agg(F.first("completeness"))
    return wide.join(F.broadcast(means) if n is not None else means, "ticker")


def missing_by_ticker(report: DataFrame, flag: str = "needs_refetch") -> DataFrame:
    return report.where(flag).groupBy("ticker").agg(F.sort_array(F.collect_list("date")).alias("dates"))


def islands(missing: DataFrame, valid_days: DataFrame) -> DataFrame:
    """(start, end, tickers) of runs of consecutive valid days that miss the same set of tickers.

    ``missing`` has (ticker, date); a valid day on which none is missing ends a run,
    and days that are not valid do not count.
    """
    # a day's set as a count and an order-free hash of 128 bits, so that no day's names meet in one row
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "ticker")).alias(f"h{seed}") for seed in (1, 2)]
    names = missing.select("date", "ticker").distinct()
    sets = names.groupBy("date").agg(F.struct(F.count(F.lit(1)).alias("n"), *hashes).alias("set"))
    days = valid_days.select("date").distinct().join(sets.select("date", F.col("set.n").alias("n"), F.col("set.h1").alias("h1"), F.col("set.h2").alias("h2")), "date", "left")
    order = W.orderBy("date")  # one row for each calendar day: bounded by the calendar, not the data
    changed = reduce(or_, (~F.col(c).eqNullSafe(F.lag(c).over(order)) for c in ("n", "h1", "h2")))
    runs = days.withColumn("run", F.sum(changed.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.where("n is not null").groupBy("run").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    # names are gathered for the first day of each run alone
    listed = names.withColumnRenamed("date", "start").join(spans, "start").groupBy("start", "end").agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"))
    return listed.select("start", "end", "tickers")


def fetch_batches(missing: DataFrame, size: int = 100) -> DataFrame:
    """(batch, first, last, start, end): tickers in order by ``size``, each batch with the half-open span of all its days."""
    spans = missing.groupBy("ticker").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    batched = numbered_chunks(spans, "ticker", size)
    return batched.groupBy("batch").agg(F.min("ticker").alias("first"), F.max("ticker").alias("last"), F.min("low").alias("start"), F.date_add(F.max("high"), 1).alias("end"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("needs_refetch").alias("to_fetch"), F.count_if(~F.col("needs_refetch")).alias("complete"))

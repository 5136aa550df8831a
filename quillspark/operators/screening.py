"""Symbol universes and reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.numbers import finite
from quillspark.functions.text import or_else
from quillspark.operators.upsert import union_by_priority
from quillspark.schemas import FUNDAMENTALS

# The screens' cuts.
MIN_EQUITY_VOLUME, MIN_ETF_VOLUME, MIN_ETF_ASSETS = 100_000, 100_000, 5e8
MOST_EQUITIES, MOST_ETFS, MOST_CRYPTOS = 2000, 200, 50


def equity_filter() -> Column:
    return (F.col("average_volume_60d_calc") >= MIN_EQUITY_VOLUME) & (F.col("type") == "stock") & F.col("is_primary")


def etf_filter() -> Column:
    """Strictly above both cuts, unlike equities."""
    return (F.col("type") == "fund") & F.array_contains("typespecs", "etf") & (F.col("average_volume_60d_calc") > MIN_ETF_VOLUME) & (F.col("aum") > MIN_ETF_ASSETS)


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of largest ``by``, ties by ``tie``."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def screen_equities(df: DataFrame, n: int = MOST_EQUITIES) -> DataFrame:
    return top(df.where(equity_filter()), "market_cap_basic", n, "name")


def screen_etfs(df: DataFrame, n: int = MOST_ETFS) -> DataFrame:
    return top(df.where(etf_filter()), "aum", n, "name")


def exclude_quote(top_rows: DataFrame, symbols: DataFrame, key: str, quote: str, excluded: str = "USD") -> DataFrame:
    """Without rows quoted in ``excluded``; rows of unknown quote stay. Applied after a limit, so fewer may be left."""
    return top_rows.join(symbols, key, "left").where(~F.col(quote).eqNullSafe(F.lit(excluded)))


def screen_cryptos(df: DataFrame, symbols: DataFrame, n: int = MOST_CRYPTOS) -> DataFrame:
    return exclude_quote(top(df, "volume", n, "name"), symbols.withColumnRenamed("symbol", "name"), "name", "quoteAsset")


def not_etfs(tracked: DataFrame, etfs: DataFrame, key: str = "ticker") -> DataFrame:
    return tracked.join(etfs, key, "left_anti")


def not_done(universe: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tickers whose backfill is not done: pending, failed or never tried."""
    return universe.join(ledger.where("status = 'done'"), "ticker", "left_anti")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ledger_rows(bars: DataFrame, tried: DataFrame, fetched_at: Column) -> DataFrame:
    """A ledger row for each tried ticker (ticker, error): done with its bars' span, not_found without bars, error with a message."""
    stats = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("n_bars").isNull(), "not_found").otherwise("done")
    return tried.join(stats, "ticker", "left").select("ticker", status.alias("status"), F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "first", "last", "error", fetched_at.alias("fetched_at"))


def resolve_ids(bases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(base, id): the candidate (base, id, rank, src_pos) of least rank; no rank, 0 and NaN come last; ties by src_pos."""
    rank = F.nullif(finite(F.col("rank")), F.lit(0.0))
    w = W.partitionBy("base").orderBy(rank.asc_nulls_last(), "src_pos")
    return bases.join(candidates, "base").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("base", "id")


def ambiguous(candidates: DataFrame) -> DataFrame:
    """Candidates of bases that have several: only these need their market rows fetched."""
    return candidates.join(candidates.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("base"), "base", "left_semi")


def crypto_fundamentals(symbols: DataFrame, coins: DataFrame, markets: DataFrame) -> DataFrame:
    """Market rows of symbols (symbol, base) by resolved coin id; an empty match is an empty table of the same columns."""
    ranked = coins.select(F.upper("symbol").alias("base"), "id", "src_pos").join(markets.select("id", F.col("market_cap_rank").alias("rank")), "id", "left")
    ids = resolve_ids(symbols.select("base").distinct(), ranked)
    return symbols.join(ids, "base").join(markets, "id").select(F.col("symbol").alias("ticker"), *(c for fields in FUNDAMENTALS["cryptos"].values() for c in fields))


def unmatched(symbols: DataFrame, coins: DataFrame) -> DataFrame:
    return symbols.join(coins.select(F.upper("symbol").alias("base")), "base", "left_anti")


def fundamentals(raw: DataFrame, asset_class: str, freq: str) -> DataFrame:
    """The fields of a class and frequency out of JSON blobs (ticker, raw); what is no finite number is NULL."""
    return raw.select("ticker", *(finite(F.get_json_object("raw", f"$.{f}")).alias(f) for f in FUNDAMENTALS[asset_class].get(freq, [])))


def equity_metadata(raw: DataFrame) -> DataFrame:
    """Normalised metadata of JSON blobs; an empty long name falls through to the short one."""
    field = lambda f: F.get_json_object("raw", f"$.{f}")
    return raw.select(
        "ticker", "asset_class", or_else(field("longName"), field("shortName")).alias("name"), field("sector").alias("sector"), field("industry").alias("industry"),
        field("currency").alias("currency"), field("exchange").alias("exchange"), field("country").alias("country"), F.lit("equities").alias("source"), "raw", finite(field("marketCap")).alias("market_cap"),
    )


def consolidated_metadata(sources: list[DataFrame]) -> DataFrame:
    """All sources, where a later one replaces an earlier one's row of the same ticker."""
    return union_by_priority(sources, "ticker")

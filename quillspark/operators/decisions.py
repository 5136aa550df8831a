"""Weights and positions to trade decisions and order requests.

A strategy is a function (bars, positions) -> decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.allocation import allocate, parameters
from quillspark.operators.indicators import crossovers, last_rows, momentum
from quillspark.operators.numbering import numbered
from quillspark.sources.shared import settled

Strategy = Callable[[DataFrame, DataFrame], DataFrame]
KINDS = ("open", "close", "replace")


def _numbered(parts: DataFrame) -> DataFrame:
    """Opens before closes, each by symbol."""
    ordered = numbered(parts, [F.when(F.col("kind") == "open", 0).otherwise(1), F.col("symbol")], "seq")
    return ordered.select(F.col("seq").cast("int").alias("seq"), "kind", "symbol", "side", "weight")


def rebalance(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """Targets (symbol, weight) against positions (symbol): open what is not held, close what is no target, leave the rest."""
    wanted = targets.where("weight <> 0")
    opens = wanted.join(positions, "symbol", "left_anti").select(F.lit("open").alias("kind"), "symbol", F.when(F.col("weight") > 0, "buy").otherwise("sell").alias("side"), F.abs("weight").alias("weight"))
    closes = positions.select("symbol").distinct().join(wanted, "symbol", "left_anti").select(F.lit("close").alias("kind"), "symbol", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("weight"))
    return _numbered(opens.unionByName(closes))


def sma_cross_strategy(fast: int = 10, slow: int = 30, weight: float = 0.1) -> Strategy:
    """Buy what crosses above and is not held; close what crosses below and is held."""

    def decide(bars: DataFrame, positions: DataFrame) -> DataFrame:
        now = last_rows(crossovers(bars, fast, slow)).where("cross is not null").select(F.col("ticker").alias("symbol"), "cross")
        opens = now.where("cross = 'above'").join(positions, "symbol", "left_anti").select(F.lit("open").alias("kind"), "symbol", F.lit("buy").alias("side"), F.lit(weight).alias("weight"))
        closes = now.where("cross = 'below'").join(positions, "symbol", "left_semi").select(F.lit("close").alias("kind"), "symbol", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("weight"))
        return _numbered(opens.unionByName(closes))

    return decide


def momentum_targets(bars: DataFrame, lookback: int, top_k: int = 3) -> DataFrame:
    """(symbol, weight): rank weights of the best positive returns; assets are in order of their names."""
    return _best(momentum(bars, lookback), top_k)


def _best(signals: DataFrame, top_k: int) -> DataFrame:
    """Weights of the ``top_k`` best signals (ticker, signal): only these are ranked against each other."""
    size = F.nanvl("signal", F.lit(0.0))
    best = signals.where(size > 0).orderBy(size.desc(), "ticker").limit(top_k)
    row = best.select(F.lit(0).alias("ts"), F.col("ticker").alias("asset"), F.col("ticker").alias("asset_pos"), "signal")
    weights = allocate(row, parameters(signals.sparkSession, "rank", top_k))
    return weights.where("weight <> 0").select(F.col("asset").alias("symbol"), "weight")


def momentum_strategy(lookback: int, top_k: int = 3) -> Strategy:
    """Hold the best movers; where no symbol has enough bars nothing is done, and holdings stay."""

    def decide(bars: DataFrame, positions: DataFrame) -> DataFrame:
        signals = settled(momentum(bars, lookback))  # a row for each symbol, read three times
        return rebalance(_best(signals, top_k), positions.limit(0) if signals.isEmpty() else positions)

    return decide


def order_requests(decisions: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """Sizes for decisions (symbol, kind, side, qty, weight, fraction): a quantity as given, or equity by weight at the latest price; closes whole or by percent."""
    unknown = F.raise_error(F.concat(F.lit("unknown decision: "), F.col("kind")))
    both = F.raise_error(F.lit("a decision has one of qty and weight"))
    sized = decisions.join(prices, "symbol", "left")
    qty = F.when(F.col("qty").isNotNull() & F.col("weight").isNotNull(), both.cast("double")).otherwise(F.coalesce("qty", F.try_divide(F.col("weight") * equity, F.col("price"))))
    percent = F.when(F.coalesce("fraction", F.lit(1.0)) >= 1, F.lit(100.0)).otherwise(F.col("fraction") * 100)
    return sized.select(
        "symbol", "kind", "side",
        F.when(F.col("kind") == "open", qty).when(~F.col("kind").isin(*KINDS), unknown.cast("double")).alias("qty"),
        F.when(F.col("kind") == "close", percent).alias("close_percent"),
    )


def broker_orders(raw: DataFrame) -> DataFrame:
    """Open orders as the library holds them: types besides limit are market, a missing quantity is 0."""
    return raw.select("order_id", "symbol", "side", F.coalesce("qty", F.lit(0.0)).alias("qty"), F.when(F.col("order_type") == "limit", "limit").otherwise("market").alias("order_type"), "limit_price")

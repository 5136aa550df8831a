"""Signals to portfolio weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import percent

METHODS = ("equal", "signal", "rank", "inverse_rank")


def parameters(spark: SparkSession, methods: str | list[str], top_ks: int | None | list[int | None]) -> DataFrame:
    """(combo, method, top_k): all combinations, methods outside; checked before anything is computed."""
    methods = [methods] if isinstance(methods, str) else list(methods)
    top_ks = list(top_ks) if isinstance(top_ks, list) else [top_ks]
    if not methods or not top_ks:
        raise ValueError("at least one method and one top_k are needed")
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"unknown method {m!r}; known: {', '.join(METHODS)}")
    for k in top_ks:
        if k is not None and k < 1:
            raise ValueError("top_k must be 1 or more")
    rows = [(i * len(top_ks) + j, m, k) for i, m in enumerate(methods) for j, k in enumerate(top_ks)]
    return spark.createDataFrame(rows, "combo int, method string, top_k int")


def allocate(signals: DataFrame, params: DataFrame, *, long_only: bool = True) -> DataFrame:
    """(method, top_k, ts, asset, asset_pos, weight) for signals (ts, asset, asset_pos, signal).

    Every input row stays: an asset that is not eligible has weight 0. Ties are
    broken by asset_pos. All windows share one partitioning, so one shuffle serves.
    An infinite signal makes its whole row 0 under ``signal``.
    """
    s = F.coalesce(F.nanvl("signal", F.lit(None).cast("double")), F.lit(0.0))
    size = F.when(s > 0, s) if long_only else F.when(s != 0, F.abs(s))
    rows = signals.withColumn("eligible", size).crossJoin(F.broadcast(params))  # params are a handful of settings
    row = W.partitionBy("method", "top_k", "ts")
    falling = row.orderBy(F.col("eligible").desc_nulls_last(), "asset_pos")
    rows = rows.withColumn("place", F.row_number().over(falling))
    rows = rows.withColumn("eligible", F.when(F.col("top_k").isNull() | (F.col("place") <= F.col("top_k")), F.col("eligible")))
    # places in the falling order are places among the eligible; the rising order has its own ties
    rising = row.orderBy(F.col("eligible").asc_nulls_last(), "asset_pos")
    rows = rows.withColumn("rise", F.row_number().over(rising))
    raw = (
        F.when(F.col("method") == "equal", 1.0)
        .when(F.col("method") == "signal", F.col("eligible"))
        .when(F.col("method") == "rank", F.col("rise").cast("double"))
        .otherwise(F.lit(1.0) / F.col("place"))
    )
    rows = rows.withColumn("raw", F.when(F.col("eligible").isNotNull(), raw).otherwise(0.0))
    total = F.sum("raw").over(row)
    weight = F.when((total > 0) & (total < float("inf")), F.col("raw") / total).otherwise(0.0)
    if not long_only:
        weight = weight * F.signum(s)
    return rows.select("method", "top_k", "ts", "asset", "asset_pos", weight.alias("weight"))


def compact_view(weights: DataFrame, n: int, *, by: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """Positive weights of each row in falling order, in columns 1 to n: ``TICKER (12.3%)``, or the asset and weight. ``by`` names the settings (method, top_k) that a sweep varies."""
    keys = ["ts", *by]
    order = W.partitionBy(*keys).orderBy(F.col("weight").desc(), "asset_pos")
    held = weights.where("weight > 0").withColumn("place", F.row_number().over(order))
    cell: Column = F.struct("asset", "weight") if pairs else F.concat("asset", F.lit(" ("), percent(F.col("weight")), F.lit(")"))
    wide = held.groupBy(*keys).pivot("place", list(range(1, n + 1))).agg(F.first(cell))
    each, same = weights.select(*keys).distinct(), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    return each.alias("a").join(wide.alias("b"), same, "left").select("a.*", *(F.col(f"b.`{i}`") for i in range(1, n + 1)))

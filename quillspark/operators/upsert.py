"""Tables with a key: upserts, snapshot replacement, ordered unions, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    last = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*last))).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], batch_order: list[str]) -> DataFrame:
    """``incoming`` over ``existing``; within a batch the last by ``batch_order`` wins. The result must be written to a new path."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["_src", *batch_order]).drop("_src")


def write_upsert(spark, path_old: str, path_new: str, incoming: DataFrame, keys: list[str], batch_order: list[str], partition: str | None = None) -> None:
    """Read the old path, write the merged table to another one; the caller swaps them. ``partition`` names a column to partition files by."""
    merged = upsert(spark.read.parquet(path_old), incoming, keys, batch_order).sortWithinPartitions(*keys)
    writer = merged.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path_new)


def touched_partitions(existing: DataFrame, incoming: DataFrame, keys: list[str], batch_order: list[str], partition: str) -> DataFrame:
    """The merged rows of those partitions only that ``incoming`` touches, for a dynamic partition overwrite."""
    parts = incoming.select(partition).distinct()
    return upsert(existing.join(parts, partition, "left_semi"), incoming, keys, batch_order)


def snapshot_replace(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key tuple is not in ``new``, and ``new``. Ranks beyond a shorter new list stay."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ordered_union(frames: list[DataFrame], key: str, pos: str, first: int | None = None) -> DataFrame:
    """(key, src, pos): distinct keys in order of the first frame and place that hold them; the ``first`` ones if given."""
    each = [f.select(F.col(key), F.lit(i).alias("_src"), F.col(pos).alias("_pos")) for i, f in enumerate(frames)]
    firsts = reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min(F.struct("_src", "_pos")).alias("_at"))
    out = firsts.select(key, F.col("_at._src").alias("src"), F.col("_at._pos").alias("pos"))
    return out if first is None else out.orderBy("src", "pos", key).limit(first)


def union_by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """Later frames replace earlier ones' rows of the same key."""
    each = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    return keep_last(both, [key], ["_src"]).drop("_src")


def changes(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, change): ``add`` for wanted only, ``remove`` for held only."""
    add = wanted.select(key).distinct().join(held, key, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(held.select(key).distinct().join(wanted, key, "left_anti").withColumn("change", F.lit("remove")))


def promote(existing: DataFrame, staging: DataFrame, is_crypto: Column) -> DataFrame:
    """The crypto rows of ``existing`` and all staged rows; other rows that are not staged are dropped."""
    return existing.where(is_crypto).unionByName(staging)

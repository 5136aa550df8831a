"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.shared import settled


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with consecutive numbers from 1 in this order (rows that tie in all of it are numbered in any order).

    Rows are dealt out by ranges of the order, numbered within their range, and moved on by the sizes of the ranges
    before: the only thing that meets in one place is one count for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_range", "n")).alias("all"))
    each = sizes.select("all", F.explode("all").alias("own"))
    before = F.aggregate("all", F.lit(0).cast("long"), lambda total, s: total + F.when(s["_range"] < F.col("own")["_range"], s["n"]).otherwise(0))
    starts = each.select(F.col("own._range").alias("_range"), before.alias("_before"))
    within = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return within.join(starts, "_range").withColumn(name, F.col("_rn") + F.col("_before")).drop("_range", "_rn", "_before")


def numbered_chunks(df: DataFrame, order: str | Column, size: int) -> DataFrame:
    """``df`` with ``batch``: consecutive chunks of ``size`` rows."""
    return numbered(df, [order], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")

"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in ``spark.checkpoint.dir``; only where it names none (tests) a local one is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if named is None and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that is run in here when it ends: what it made is in the shared folder then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from there: nothing upstream is run again, a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: Spark takes the setting where a frame is made


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, for what is larger than ``cut`` should hold, and its path for ``remove``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_sample(df: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` rows of ``df``: the first ones by hash of those below a hash cut that the counted rows set, so the same rows each time."""
    n = df.count()
    if n <= max_rows:
        return df
    hashed = F.xxhash64(key, F.lit(17))
    return df.where(hashed < -(2**63) + 2**64 * 19 * max_rows // (20 * n)).orderBy(hashed, key).limit(max_rows)


def fitting(sizes: pd.DataFrame, max_bytes: int) -> list[int]:
    """Which rows (doc_id, bytes, group, h) to take: whole texts in hash order, those that do not fit are passed over.

    Each group has an equal share of the bytes; what a small one leaves goes to the others. A group of which nothing fits gives
    its smallest text, so no group goes missing: the bound may be exceeded by one text for each such group.
    """
    groups = [g.sort_values("h") for _, g in sizes.groupby("group", dropna=False)]
    out: list[int] = []
    for i, g in enumerate(sorted(groups, key=lambda g: int(g["bytes"].sum()))):
        share, used, taken = max_bytes // (len(groups) - i), 0, []
        for doc_id, size in zip(g["doc_id"].tolist(), g["bytes"].tolist(), strict=True):
            if used + size <= share:
                used += size
                taken.append(doc_id)
        out += taken or g.sort_values(["bytes", "h"])["doc_id"].tolist()[:1]
        max_bytes = max(0, max_bytes - used)
    return out


def sampled_texts(documents: DataFrame, sample: DataFrame, max_bytes: int, group: str) -> pd.DataFrame:
    """The ``documents`` rows (doc_id, text, ...) of a bounded ``sample``, in order of doc_id, with its columns: one row for each doc_id
    (that of the least text), as many as ``fitting`` takes by the values of the column ``group``."""
    rows = documents.join(F.broadcast(sample), "doc_id")  # bounded rows of numbers
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("missing"), "text", *others)).alias("row"))
    one = cut(one.select("doc_id", "row.text", *(f"row.{c}" for c in others)))
    sizes = one.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.col(group).alias("group"), F.xxhash64("doc_id", F.lit(17)).alias("h")).toPandas()
    fits = F.broadcast(documents.sparkSession.createDataFrame([(int(i),) for i in fitting(sizes, max_bytes)], "doc_id long"))
    return one.join(fits, "doc_id", "left_semi").toPandas().sort_values("doc_id", ignore_index=True)

"""A training-corpus pipeline: each stage takes what the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``.

Decisions go by doc_id; rows that repeat one, or have none, are judged each by itself, under a key made of
their own columns (``keyed``). Of rows that are equal in all of them one stays in the near-duplicate stage. A null text is an
empty one in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_dedup, pieces, quality, secrets
from quillspark.llm._spark import cut, ensure_checkpoint_dir, remove, table
from quillspark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, loose (the doc_id is null or repeats), and key: the doc_id, of a loose row a hash of its columns."""
    shared = cut(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("same")))
    if shared.isEmpty():
        return docs.select(*COLUMNS, F.lit(False).alias("loose"), F.col("doc_id").cast("long").alias("key"))
    marked = docs.select(COLUMNS).join(shared.withColumn("loose", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("same")), "left")
    own = F.xxhash64(*(F.struct(F.col(c).isNull(), c) for c in COLUMNS[:4]))
    return marked.select(*COLUMNS, F.coalesce("loose", F.lit(False)).alias("loose"), F.when(F.col("loose"), own).otherwise(F.col("doc_id").cast("long")).alias("key"))


def judged(docs: DataFrame) -> DataFrame:
    """What the operators take: the key as doc_id."""
    return docs.select(F.col("key").alias("doc_id"), "text", "lang", "source")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The keyed documents that are not among the rejected ones, which a stage writes first, so that Spark knows their size when it joins."""
    return docs.join(cut(rejected.select(F.col("doc_id").alias("key"))), "key", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    docs = keyed(docs)
    scored = quality.score_quality(judged(docs), table(spark, sf_dir, "labels"))
    return without(docs, scored.where(~F.col("keep"))).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    docs = keyed(docs)
    kept = without(docs, near_dedup.near_duplicates(judged(docs)).where(~F.col("kept")))
    return kept.where(~F.col("loose")).unionByName(kept.where("loose").dropDuplicates(["key"])).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    docs = keyed(docs)
    marked = decontaminate.decontaminate(judged(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, marked.where(F.size("items") > 0)).select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    scanned = secrets.scan(docs, keep=tuple(COLUMNS[1:]))
    return scanned.select("doc_id", secrets.redact(scanned).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text back."""
    coded = pieces.encode(docs, tokenizer("piece_bpe_32k.model"), keep_text=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("sentencepiece", encoding_stage),
]

#: The near-duplicate groups and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{shared}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage has replaced
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

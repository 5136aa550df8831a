"""The pipeline against a plain version of its stages."""


import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillspark.llm import quality, queries
from tests.llm.test_near_dedup import brute
from tests.llm.test_texts import MODEL, base, contamination

SF = "/root/testdata/sf0.001"


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    assert set(entry.queries()) >= {"pipeline", *queries.QUERIES}
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_run(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    kept = [i for i, (_, _, k) in brute([(i, rows[i]["text"]) for i in sorted(good)]).items() if k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i, c in zip(kept, contamination([rows[i]["text"] for i in kept], items), strict=True) if not c[4]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean) and 0 < len(clean) < len(rows)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in clean:
        text, at, out = rows[i]["text"], 0, ""
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in base(text)):
            out += text[at:s] + "[REDACTED]" if s >= at else ""
            at = max(at, e)
        assert list(got[i]["ids"]) == model.encode(out + text[at:]), i
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, k, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KINDS)
    return corpus_pipeline.STAGES[k][1](spark, docs, SF)


def test_loose_rows_near_dedup(spark):
    """Rows without an id, of repeated ids, and equal ones."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (1, a), (None, a), (2, b), (2, c), (None, c), (None, "alone"), (None, "alone"), (4, None), (4, ""), (5, "x " * 30_000)]
    got = [(r["doc_id"], r["text"]) for r in stage(spark, 1, rows).collect()]
    texts = [t for _, t in got]
    assert [texts.count(t) for t in (a, b, c, "alone")] == [1, 1, 1, 1]
    assert {(4, None), (4, ""), (5, "x " * 30_000)} <= set(got) and len(got) == 7


def test_loose_rows_decontamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) >= 12").first()["text"]
    rows = [(None, item), (None, "clean"), (7, item), (7, "clean too"), (8, None), (8, None), (9, "w " * 30_000 + item), (10, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, 2, rows).collect()), key=str)
    assert got == sorted([(None, "clean"), (7, "clean too"), (8, None), (8, None), (10, "")], key=str)


def test_loose_rows_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad, good = scored.orderBy("score", "doc_id").first()["doc_id"], scored.orderBy(scored["score"].desc(), "doc_id").first()["doc_id"]
    text = {r["doc_id"]: r["text"] for r in docs.where(docs["doc_id"].isin(bad, good)).collect()}
    more = [(None, text[bad]), (None, text[good]), (-1, text[bad]), (-1, text[good]), (-2, None), (-2, None)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], KINDS))
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[0][1](spark, every, SF).collect()}
    assert {(None, text[good]), (-1, text[good])} <= got and not {(None, text[bad]), (-1, text[bad])} & got


def test_loose_rows_secrets(spark):
    long = "token=abcdef123 \u00e9\U0001f600 " * 20_000
    rows = [(None, "password: hunter22 x"), (3, None), (3, ""), (4, long), (4, "plain")]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in stage(spark, 3, rows).collect()), key=str)
    want = [(None, "[REDACTED] x", 12), (3, None, None), (3, "", 0), (4, "[REDACTED] \u00e9\U0001f600 " * 20_000, 14 * 20_000), (4, "plain", 5)]
    assert got == sorted(want, key=str)

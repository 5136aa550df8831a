"""Registered text queries over whole tables against brute force or the library, and rows of odd ids and names."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, near_dedup, pieces, quality, queries, toxicity, url_filter
from tests.llm.test_near_dedup import brute
from tests.llm.test_texts import MODEL, base, deduplicated, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)  # the plain versions go by doc_id
    return [(r["doc_id"], r["text"]) for r in rows]


def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op2_near_duplicates(spark, SF).collect()}
    assert got == brute(texts) and not all(kept for _, _, kept in got.values())


def test_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {(i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, t in texts for ids in [model.encode(t or "")]}
    assert {tuple(r)[:4] for r in queries.op4_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_suffix_dedup(spark, texts):
    got = queries.op5_suffix_dedup(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == deduplicated([t for _, t in texts]) and any(r["n_removed"] for r in got)


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has no secrets
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op9_secrets(spark, sf).collect()}
    assert len(got) == len(texts) and any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values())
    for i, t in texts:
        want, r = base(t), got[i]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k + ":") for s in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == sha(",".join(want)) and set(want) <= set(r["spans"].split(","))


CLASHING = ["key", "row", "x", "score", "h", "n", "group", "label", "block", "held_out", "band", "shard", "host", "id"]


def odd_rows(spark):
    """Repeated, equal and null ids, null and empty texts, and columns with names that operators use inside."""
    english, german = "the quick brown fox jumps over the lazy dog again and again", "der schnelle braune Fuchs springt immer wieder über den faulen Hund"
    rows = [(i, (english, german)[i % 2] + f" {i}", ("en", "de")[i % 2], "s") for i in range(40)]
    rows += [(1, english, "en", "s"), (1, english, "en", "s"), (None, english, "en", None), (None, None, None, None), (50, "", "de", "s")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.withColumns({c: F.lit("other") for c in CLASHING})


def test_models_on_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    toxic = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(toxic) == 45 and all(0 <= r["score"] <= 1 and (r["held_out"] is None) == (r["doc_id"] is None) for r in toxic)
    langs = language.identify(docs, language.fit(docs, steps=5)).collect()
    assert len(langs) == 45 and sum(r["lang_pred"] == "und" for r in langs) == 2
    good = quality.score_quality(docs, labels).collect()
    assert len(good) == 45 and all(0 <= r["score"] <= 1 for r in good)


def test_searches_on_odd_rows(spark):
    docs = odd_rows(spark)
    groups = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in groups} == set(range(40)) | {50}  # rows of one id are one document, a null id is none
    made = pieces.encode(docs, MODEL).collect()
    assert len(made) == 45 and len({tuple(r["ids"]) for r in made if r["doc_id"] == 1}) == 2
    urls = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string").withColumns({c: F.lit("other") for c in ["key", "host", "path", "rule", "verdict", "shard"]})
    rules = spark.createDataFrame([("b", "/c", "block")], "host string, path string, verdict string").withColumn("key", F.lit(1))
    assert [r["verdict"] for r in url_filter.filter_urls(urls, rules).orderBy(F.col("page_id").desc_nulls_last()).collect()] == ["block", "block", "allow"]

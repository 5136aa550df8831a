"""Samples and scans on texts that are far longer than others."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, secrets, toxicity
from quillspark.llm._spark import fitting, sampled_texts

ACCESS = "AKIA" + "ABCDEFGH12345678"


def test_fitting():
    """Texts that do not fit are passed over, every group keeps a part, what one leaves goes to the others."""
    frame = lambda rows: pd.DataFrame(rows, columns=["doc_id", "bytes", "group", "h"])
    assert fitting(frame([(1, 1000, "en", 0), (2, 10, "en", 1), (3, 10, "en", 2)]), 100) == [2, 3]
    rows = [(i, 10, "en", i) for i in range(1000)] + [(1000 + i, 10, "de", 10**6 + i) for i in range(3)]
    got = fitting(frame(rows), 1000)
    assert {1000, 1001, 1002} <= set(got) and len(got) == 100
    assert fitting(frame([(1, 500, "en", 0), (2, 400, "en", 1), (3, 5, None, 2)]), 100) == [3, 2]
    assert fitting(frame([]), 100) == []


def test_one_row_of_a_repeated_id(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(8, None, "de"), (8, "b", "de")], "doc_id long, text string, lang string"))
    got = sampled_texts(docs, docs.select("doc_id").distinct(), 1000, "lang")
    assert got.to_dict("records") == [{"doc_id": 7, "text": "text 0", "lang": "en"}, {"doc_id": 8, "text": "b", "lang": "de"}]


def texts(rng, words, n, length=30):
    return [" ".join(rng.choices(words, k=length)) for _ in range(n)]


WORDS = {"en": ["the", "house", "of", "thing", "with", "which"], "de": ["der", "Haus", "und", "für", "über", "nicht"], "fr": ["le", "maison", "où", "être", "très", "été"]}


def test_language_with_one_long_text(spark):
    """A text beyond the bound is passed over; a language of 1 in 100 survives a bound that cuts most bytes."""
    rng = random.Random(1)
    rows = [(lang, t) for lang, n in (("en", 900), ("de", 100), ("fr", 10)) for t in texts(rng, WORDS[lang], n)]
    rows.append(("en", "the house " * 300_000))
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    for long_first in (True, False):
        if long_first:  # an id that is in the sample
            docs = docs.withColumn("doc_id", F.when(F.length("text") > 10**6, F.lit(10**9 + 7).cast("long")).otherwise(F.col("doc_id")))
        model = language.fit(docs, max_fit_bytes=20_000, max_fit_rows=200, steps=150)
        assert model["languages"] == ["de", "en", "fr"]
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count()
    assert found / docs.count() > 0.95


def test_toxicity_with_one_long_text(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["calm", "sea", "tree", "good", "walk"], k=20) + (["vile", "scum"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    rows.append((600, "vile sea " * 500_000, 1))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, max_fit_bytes=100_000)).join(labels, "doc_id")
    assert scored.where("predicted = toxic").count() / len(rows) > 0.95


@pytest.mark.parametrize("unit", ["a-", "1.", "x", "a.", "password ", "http://a", "AKIA-"])
def test_scan_of_a_long_text(unit):
    """20 MB of what patterns are slow on, with identifiers at both ends and in the middle."""
    half = unit * (10_000_000 // len(unit))
    text = f"{ACCESS} " + half + f" {ACCESS} secret=abcdef99 s3.eu.example.com " + half + f" {ACCESS}"
    began = time.monotonic()
    base = secrets.base_spans(text)
    linked = secrets.linked_spans(text, base, 300)
    assert time.monotonic() - began < 10  # a few seconds; machines differ
    assert ("endpoint", text.index("s3.eu"), text.index("s3.eu") + 17) in linked
    assert sum(k == "access" for k, _, _ in base) == 3


def test_scopes_cut_no_part():
    """Parts at a scope's edge are whole or not there, as in a search of the whole text."""
    host = "aa.bb.example.com"
    for shift in range(-25, 26):
        text = f"{ACCESS} secret=abcdef99 "
        text += "." * (len(ACCESS) + 300 - len(text) + shift) + " " + host + " end"
        linked = secrets.linked_spans(text, secrets.base_spans(text), 300)
        inside = text.index(host) + len(host) <= len(ACCESS) + 300
        assert [s for s in linked if s[0] == "endpoint"] == ([("endpoint", text.index(host), text.index(host) + len(host))] if inside else [])


def test_items_of_one_window_are_one_context(spark):
    """A window that 300 items hold is joined once for each document; every item is reported."""
    from quillspark.llm import decontaminate

    shared = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(f"i{i}", shared) for i in range(300)] + [("two", "alone here")], "item_id string, text string")
    contexts = decontaminate.benchmark_contexts(items, 10, 5)
    assert contexts.count() == 2
    docs = spark.createDataFrame([(i, f"a{i} b {shared} c", "x") for i in range(50)] + [(99, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x9 all alone", "y")], "doc_id long, text string, words string")
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], len(r.items)) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {i: (13, [(2, 12)], 300) for i in range(50)} | {99: (12, [], 0)}


def test_extension_finds_every_window(spark):
    """Spans of all lengths around the window, at texts' ends, with repeated words and equal hashes, against a plain search."""
    from quillspark.llm import decontaminate

    rng = random.Random(12)
    make = lambda n, k: [str(rng.randint(0, k)) for _ in range(n)]
    items = [(f"i{i}", make(n, k)) for i, (n, k) in enumerate([(40, 30), (10, 30), (11, 2), (25, 1), (3, 9), (9, 9), (1, 50), (60, 60), (14, 14)])]
    docs = []
    for i in range(120):
        words = make(rng.randint(0, 30), 60)
        for _ in range(rng.randint(0, 3)):
            _, own = rng.choice(items)
            a = rng.randint(0, len(own) - 1)
            words += own[a : a + rng.randint(1, 16)] + make(rng.randint(0, 4), 60)
        docs.append((i, words))
    frame = lambda rows, schema: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], schema)
    marked = decontaminate.decontaminate(frame(docs, "doc_id long, text string"), frame(items, "item_id string, text string"))
    got = {r.doc_id: ({j for s in r.spans for j in range(s["start"], s["end"])}, r["items"]) for r in marked.collect()}
    for i, words in docs:
        hit, met = set(), set()
        for name, own in items:
            size = min(10, len(own))
            for w in {tuple(own[j : j + size]) for j in range(len(own) - size + 1)}:
                for j in range(len(words) - size + 1):
                    if tuple(words[j : j + size]) == w:
                        hit |= set(range(j, j + size))
                        met.add(name)
        assert got[i] == (hit, sorted(met)), i

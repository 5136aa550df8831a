"""Collocations against a plain version and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import collocations, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], top: int, max_words: int, min_count: int) -> set[tuple]:
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        covered = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        best = []
        for p, a in cand.items():
            if 100 * covered[p] >= 80 * a:
                continue
            points, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-points, -a, " ".join(p).encode(), left, right))
        for rank, (points, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -points))
    return out


def rows_of(df) -> set[tuple]:
    assert df.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r)[:8] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "doc_id long, text string, lang string, phrase string, f long"


def corpus(rng: random.Random) -> list[tuple]:
    words = ["The", "the", "cat", "sat", "on", "Éa", "éa", "x-y", "\x00z", "中", "(a)", "word" * 30]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!? "]
    made = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        made.append((text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return made + [made[0]] * 5 + [(None, "en"), ("", None), (" \t. ", "fr"), ("cat sat on " * 3000, "en"), ("q" * 50_000 + " r", "en"), ("only", "xx")]


@pytest.mark.parametrize(("width_bits", "bitmap_bits", "block_bytes"), [(None, 27, 1 << 22), (12, 12, 300), (22, 10, 2000), (22, 1, 900), (8, 4, 1 << 16)])
def test_plain_version(spark, width_bits, bitmap_bits, block_bytes):
    """Whatever the sketch's width, the bitmap's folding and the blocks' size, the counts are exact."""
    rows = corpus(random.Random(width_bits))
    frame = spark.createDataFrame([(i % 7, t, lang, "p", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = rows_of(collocations.collocations(frame, top=40, min_count=5, width_bits=width_bits, bitmap_bits=bitmap_bits, block_bytes=block_bytes))
    assert got == plain(rows, 40, 4, 5)


def test_other_lengths_and_large_counts(spark):
    rows = [("a b " * 400 + "a c", "en"), ("a b", "en")]
    frame = spark.createDataFrame([(1, *r, None, None) for r in rows], SCHEMA)
    for max_words, min_count in ((2, 300), (3, 2)):
        assert rows_of(collocations.collocations(frame, top=9, max_words=max_words, min_count=min_count)) == plain(rows, 9, max_words, min_count)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0


def test_long_text_parts():
    """Parts of a long text bring the words that their n-grams reach, and own each n-gram once."""
    text = " ".join(f"w{i}" for i in range(5000)) + "  tail" + "y" * 3000 + " end"
    own = []
    for _, _, data, _, limit in collocations.blocks(pa.array([text]), 100, 4):
        block = collocations.Block(data, np.array([0, len(data)]), limit)
        words = [data[a:b].tobytes().decode() for a, b in zip(block.starts, block.ends, strict=True)]
        own += [tuple(words[i : i + 4]) for i in range(block.own) if i + 4 <= len(words)]
    words = text.split()
    assert own == [tuple(words[i : i + 4]) for i in range(len(words) - 3)]


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = db.sql(queries.ORACLE_SQL["op11_collocations"]).fetchall()
    got = rows_of(queries.op11_collocations(spark, sf))
    assert len(want) > 200
    assert got == set(want)
    assert got == plain(db.sql("SELECT text, lang FROM documents").fetchall(), 2000, 4, 30)

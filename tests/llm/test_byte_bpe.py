"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import byte_bpe, queries
from quillspark.llm._text import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def encoded(coder: byte_bpe.ByteCoder, texts: list[str]) -> list[list[int]]:
    out = []
    for _, _, data, offsets in slices(pa.array(texts), 1 << 24):
        ids, counts = coder.encode(data, offsets)
        assert coder.decode(ids).tobytes() == data.tobytes()
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


ODD = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'t", "'V", "a", "b", "the", "é", "ß", "中", "１", "2", "!", '"', "----", " ", "　", "😀", "́", "ing", "tion", "r", "v", "\r\n", "\x1c", "\x85", "<|endoftext|>"]


def test_odd_texts(library):
    rng = random.Random(5)
    texts = ["", "'", "''s", " 's", "'s's", "x" * 4000, "ab" * 4000, "-" * 999, " " * 3000 + "x", "The cat. " * 150_000, "é" * 5000]
    texts += ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(4000)]
    assert encoded(byte_bpe.coder(RANKS), texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\nstrevldaz0.")), max_size=60), min_size=1, max_size=20))
def test_any_texts(texts):
    held = tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.coder(RANKS).ranks, special_tokens={})
    assert encoded(byte_bpe.coder(RANKS), texts) == [held.encode_ordinary(t) for t in texts]


def test_ranks_out_of_order():
    """Ranks in which a merge makes a pair of a lower rank, so the word's other merges must wait."""
    rng = random.Random(3)
    classes = byte_bpe.coder(RANKS).classes
    for _ in range(30):
        made = {bytes([i]) for i in range(256)}
        longer = set()
        while len(longer) < 60:
            longer.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        order = rng.sample(sorted(longer), len(longer))
        ranks = {t: i for i, t in enumerate([*sorted(made), *order])}
        held = tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(60)]
        assert encoded(byte_bpe.ByteCoder(ranks, classes), texts) == [held.encode_ordinary(t) for t in texts]


def test_rows(spark, library):
    """Null, empty, repeated and long texts, null ids, other columns with clashing names; a cut text is encoded as a whole one."""
    long = "Ein Wort, " * 300_000
    rows = [(1, "It's 5 o'clock.", "x"), (1, "It's 5 o'clock.", "x"), (None, None, None), (2, "", "y"), (3, long, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)
    got = [(r.doc_id, list(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(frame, RANKS, block_bytes=64).collect()]
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert got == want
    assert byte_bpe.encode(frame.limit(0), RANKS).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op12_byte_bpe(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        want.add((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == want

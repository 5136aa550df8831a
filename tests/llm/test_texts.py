"""Operators on single texts and benchmark joins against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, pieces, queries, secrets, suffix_dedup
from quillspark.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, item_id string, h long"
MODEL = tokenizer("piece_bpe_32k.model")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], DOCS)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = []
    for t in texts:
        w = split(t)
        hit, found = [False] * len(w), set()
        for i, item in items:
            v = split(item)
            n = min(10, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = [True] * n
                    found.add(str(i))
        out.append((len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    text = lambda n, v=12: " ".join(rng.choice(["Foo", "bar!", "ÉÀ", "x9"]) + str(rng.randrange(v)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 11, 10, 9, 5, 2, 1, 0, 40])] + [(20, None), (21, "!!!"), (3, "another text for an id that is there already and is longer")]
    items += [(100 + i, t) for i, (_, t) in enumerate(items[:3])]
    texts = [text(rng.randrange(60), 30) for _ in range(40)] + [None, "", "..."]
    for _ in range(40):
        _, t = rng.choice(items[:9])
        texts.append(f"{text(5, 99)} {t.upper()}, {text(5, 99)} {t[: rng.randrange(len(t) + 1)]}")
    texts.append(" ".join(["pad"] * 30000) + " " + items[0][1])
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.digest(decontaminate.decontaminate(docs(spark, texts), bench)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == contamination(texts, items)


def test_decontamination_keeps_every_row(spark):
    """Null and repeated ids, equal rows included: one result for each row."""
    texts = ["p q a b c d e f g h i j r", "clean text", None]
    rows = [(i, t) for i in (1, 1, None) for t in texts] + [(None, texts[0])]
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got) == sorted((i or 0, *{texts[0]: (13, 10), texts[1]: (2, 0), None: (0, 0)}[t]) for i, t in rows)


def test_decontamination_query(spark):
    """The registered query over whole tables against brute force."""
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op3_decontamination(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == contamination([t for _, t in texts], items) and any(r["contaminated"] for r in got)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    got = decontaminate.digest(decontaminate.decontaminate(docs(spark, ["a b"]), bench.limit(0))).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (2, 0, False)


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  ", "▁", "tab\tand\nline", "<s> <0x41>", "\x00", "世界 ﬁ é", "word " * 20000, "x" * 5000]
    texts += ["".join(rng.choice("ab  ▁\n\té<0x>ﬁ世🙂") for _ in range(rng.randrange(40))) for _ in range(300)]
    got = pieces.encode(docs(spark, [*texts, None]), MODEL, table_rows=50).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in got] == [model.encode(t) for t in [*texts, ""]]
    assert [r["decoded"] for r in got] == [model.decode(model.encode(t)) for t in [*texts, ""]]
    assert pieces.encode(docs(spark, []), MODEL).count() == 0


def base(text):
    kinds = [("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in found]


ACCESS, KEY = "AKIA" + "ABCD" * 4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
SECRETS = [
    None, "", "PassWord = 'hunter22' token:abc api-key=zzzzzzzz ApI_kEy=\"abcdef\"", "🙂é token=ABCDEF12 " + "0123456789abcdef" * 2, "secret=secret=abcdefg", "AKIAAKIA" + "X" * 20 + " AKIA12",
    f"id {ACCESS} key {KEY} at https://s3.example.com:9000/x", f"key {KEY} alone at https://s3.example.com", f"{ACCESS} https://s3.example.com", f"{ACCESS}{' ' * 400}{KEY}", f"secret={KEY} {ACCESS}", "toKen = ſecret paſſword=abcdefgh", "f" * 100000,
]


def test_secrets(spark):
    got = secrets.digest(secrets.scan(docs(spark, SECRETS))).orderBy("doc_id").collect()
    for r, t in zip(got, SECRETS, strict=True):
        want = base(t)
        assert r["base_sha256"] == sha(",".join(want))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in r["spans"].split(",") if x and x.split(":")[0] in ("assign", "access", "hex")] == want
    weak = [[x.split(":")[0] for x in r["spans"].split(",") if x.startswith(("key", "endpoint"))] for r in got]
    assert weak[6] == ["key", "endpoint"] and not any(weak[:6] + weak[7:])
    assert secrets.scan(docs(spark, [])).count() == 0


def test_assigned_secrets_link_endpoints(spark):
    end, run = "https://s3.example.com", "0123456789abcdef" * 2
    linked = [f"id {ACCESS} secret={KEY} at {end}", f"{ACCESS} token: abcdef12 {end}", f"{ACCESS} {run} {end}"]
    loose = [f"secret={KEY} at {end}", f"{run} at {end}", f"api_key={ACCESS} {end}", f"{ACCESS} {end}{' ' * 400}secret={KEY}"]
    scanned = secrets.scan(docs(spark, linked + loose), keep=("text",))
    got = scanned.withColumn("out", secrets.redact(scanned)).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["linked"]] for r in got] == [["endpoint"]] * 3 + [[]] * 4
    assert [end in r["out"] for r in got] == [False] * 3 + [True] * 4


def test_redaction(spark):
    scanned = secrets.scan(docs(spark, SECRETS), keep=("text",))
    for r in scanned.withColumn("out", secrets.redact(scanned)).orderBy("doc_id").collect():
        if r["text"] is None:
            assert r["out"] is None
            continue
        spans, out, at = sorted((s["start"], s["end"]) for s in r["base"] + r["linked"]), "", 0
        for s, e in spans:
            if s >= at:
                out += r["text"][at:s] + "[REDACTED]"
            at = max(at, e)
        assert r["out"] == out + r["text"][at:] and not base(r["out"].replace("[REDACTED]", "\n"))


def deduplicated(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        covered, new = np.zeros(len(b) + 1, dtype=int), []
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                covered[s] += 1
                covered[s + 50] -= 1
            new.append(b[s : s + 50])
        seen.update(new)
        gone = np.cumsum(covered)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(8)
    text = lambda n, a="abcé ": "".join(rng.choice(a) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 400)]
    texts = ["", None, "a" * 49, "a" * 50, "a" * 300, "ab" * 200, text(3000), shared[4]]
    for _ in range(40):
        texts.append("".join(text(rng.randrange(30)) + (rng.choice(shared) if rng.random() < 0.7 else "") for _ in range(rng.randrange(4))))
    texts += [texts[6], texts[6][100:2000] + "z", shared[4], shared[4][:200] + "!" + shared[4][200:], "a" * 60]
    got = suffix_dedup.digest(suffix_dedup.deduplicate(docs(spark, texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == deduplicated(texts)
    assert suffix_dedup.deduplicate(docs(spark, [])).count() == 0


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 6)
    rng = random.Random(4)
    text = lambda n, a="abcé ": "".join(rng.choice(a) for _ in range(n))
    passage = text(200)
    texts = [text(rng.randrange(80)) + rng.choice([passage, passage[20:120], "-" * 90, "-" * rng.randrange(60)]) + text(rng.randrange(80)) for _ in range(40)] + [text(300)] * 2 + [None, ""]
    own = docs(spark, texts)
    found, _ = suffix_dedup.shared_contexts(own, suffix_dedup.whole_copies(own))
    sizes = found.groupBy("h", "hot").count().collect()
    assert sum(r["hot"] for r in sizes) > 3 and max(r["count"] for r in sizes if not r["hot"]) <= 6
    got = suffix_dedup.digest(suffix_dedup.deduplicate(own)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == deduplicated(texts)


def test_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2000)
    rng = random.Random(6)
    text = lambda n, a="abcé ": "".join(rng.choice(a) for _ in range(n))
    long = text(40_000) + "-" * 5000 + text(3000)
    texts = [long[100:9000] + "!", long, "-" * 4000, long[9000:] + text(100), "x" * 70_000]
    got = suffix_dedup.digest(suffix_dedup.deduplicate(docs(spark, texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == deduplicated(texts)
    # rows of one doc_id do not remove each other; equal rows are cut alike; null ids keep all
    rows = [(1, long[:300]), (2, long[:300]), (2, "a" + text(200)), (2, "a" + long[50:200]), (2, "a" + long[50:200]), (None, long[:300]), (None, None)]
    got = suffix_dedup.digest(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    n = lambda t: len(t.encode())
    want = [(1, n(long[:300]), 0), (2, n(long[:300]), n(long[:300])), (2, n(rows[2][1]), 0), *[(2, n(rows[3][1]), n(rows[3][1]) - 1)] * 2, (None, n(long[:300]), 0), (None, 0, 0)]
    assert sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"]) for r in got) == sorted((i or 0, a, b) for i, a, b in want)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_classes(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(97, 97 + letters, 700).astype(np.uint8)
    text[rng.integers(0, 700, 4)] = 120
    text[350:600] = text[:250]
    starts = np.sort(rng.choice(650, 300, replace=False))
    got = suffix_dedup.suffix_classes(text, starts)
    strings = [text[i : i + 50].tobytes() for i in starts]
    assert [s for _, s in sorted(zip(got.tolist(), strings, strict=True))] == sorted(strings)
    assert len(set(zip(got.tolist(), strings, strict=True))) == len(set(strings)) == len(set(got.tolist()))


def test_columns_may_clash(spark):
    clash = docs(spark, ["some text"]).withColumns({"spans": F.lit(1), "n_words": F.lit(2), "place": F.lit(3), "key": F.lit(4)})
    bench = spark.createDataFrame([(1, "a b", 3)], "item_id long, text string, f int")
    assert decontaminate.decontaminate(clash, bench).count() == 1
    assert suffix_dedup.deduplicate(clash).count() == 1
    assert secrets.scan(clash).count() == 1

"""Searches, filters and trained models: brute force, held-out accuracy, edges."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, quality, queries, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, want))


def nearest(rows, asked, k):
    out = []
    for q, code in asked:
        d = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows if i != q)
        out += [(q, i, n, r + 1) for r, (n, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "k", "segments"), [(400, 5, None), (400, 3, 4), (6, 10, None), (50, 4, 16)])
def test_topk(spark, n, k, segments):
    rng = random.Random(n + k)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(n // 8 + 1)]
    rows = [(i, rng.choice(codes) ^ (rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) if i % 3 else 0)) for i in range(n)] + [(n, None), (None, 5)]
    df = spark.createDataFrame(rows + rows[:1], "id long, code long")
    got = topk.top_k(df, df.where("id % 5 = 0"), k, segments=segments).collect()
    held = [r for r in rows if None not in r]
    assert sorted(map(tuple, got)) == nearest(held, [r for r in held if r[0] % 5 == 0], k)


def test_topk_in_a_cluster_of_near_copies(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    near = lambda: center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
    rows = [(i, (near() if i % 3 == 0 else rng.getrandbits(64)) - 2**63) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, code long").withColumns({"q": F.lit(1), "seg": F.lit(2), "held": F.lit("x")})
    got = topk.top_k(df, df.where("id % 50 = 0"), 6).collect()
    assert sorted(map(tuple, got)) == nearest(rows, [r for r in rows if r[0] % 50 == 0], 6)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "id long, code long")
    assert topk.top_k(df, df, 3).count() == 0


def test_sign_code(spark):
    row = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), (None,)], "embedding array<float>").select(topk.sign_code().alias("c")).collect()
    assert [r["c"] for r in row] == [0b1001, None]


URLS = {
    "http://A.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "x://w.www.example.com/en/#": ("w.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://a.net/es/1://b": ("a.net", "/es/1://b", "net/es/", "block"),
    "http://a.net/es": ("a.net", "/es", None, "allow"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://?q": ("", "", None, "allow"),
    "mailto:a.net/fr/": ("", "", None, "allow"),
    "http://É.net/fr/\nz": ("É.net", "/fr/\nz", "net/fr/", "block"),
}


def test_url_filter(spark):
    rows = [(i, u, "v") for i, u in enumerate([*URLS, None, ""])]
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [*URLS.values(), ("", "", None, "allow"), ("", "", None, "allow")]
    none = url_filter.filter_urls(spark.createDataFrame(rows[:1], "page_id long, url string, verdict string"), rules.limit(0)).first()
    assert none["rule"] is None and none["verdict"] == "allow"
    shards = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules, shard_bytes=40).orderBy("page_id").collect()
    assert shards == got
    with pytest.raises(ValueError):
        url_filter.filter_urls(spark.createDataFrame(rows[:1], "page_id long, url string, v string"), rules.withColumn("verdict", F.expr("uuid()")).union(rules))


def fitting(url, rules, default="allow"):
    """The longest rule that fits, by trying all of them."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:end].translate({i: i + 32 for i in range(65, 91)}), rest[end:].split("?")[0].split("#")[0]
    held = [(len((h + p).encode()), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(held, default=(0, 0, None, default))[2:])


def test_long_urls(spark):
    """Hosts of very many labels and long paths against trying every rule."""
    rng = random.Random(5)
    host = lambda n: ".".join(rng.choice("abc") for _ in range(n))
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in {(host(rng.randrange(1, 4)), "/" + "é/x" * rng.randrange(3)) for _ in range(40)}]
    urls = [f"http://{host(n)}/{'é/x' * m}{tail}" for n in (1, 2, 3, 5, 200_000) for m in (0, 1, 2, 50_000) for tail in ("", "?q", "z")] + ["http://" + "a" * 100_000 + ".b/", "x://..a/", "://a.b/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(rows, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [fitting(u, rules) for u in urls]


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    path = str(tmp_path / "d")
    url_filter.DigestArray.build(path, [("a", "/", "block"), ("b", "/", "allow")])
    assert url_filter.DigestArray(path).find([b"a/", b"b/", b"c/"]) == ["block", "allow", None]
    with pytest.raises(ValueError):
        url_filter.DigestArray.build(path, [("a", "/", "block"), ("a", "/", "allow")])


def labelled(spark, n=700):
    rng = random.Random(9)
    words = {"en": ["the", "and", "with", "thing", "tion"], "de": ["und", "über", "schön", "keit", "ein"], "fr": ["être", "déjà", "une", "eau", "ç"]}
    bad = ["idiot", "trash", "scum"]
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(words))
        t = [rng.choice(words[lang]) + (str(rng.randrange(50)) if rng.random() < 0.1 else "") for _ in range(rng.randrange(20, 80))]
        toxic, junk = int(rng.random() < 0.3), rng.random() < 0.3
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(bad)
        text = "!! ".join(t).upper() if junk else " ".join(t)
        docs.append((i, text, lang, f"host{i % 7}", i))
        labels.append((i, int(not junk), toxic))
    docs += [(n, None, "en", None, 0), (n + 1, "", None, "host0", 0), (n + 2, "12 !?", "en", "host0", 0), (n + 3, "the " * 30000, "en", "host0", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.held_out(F.col("doc_id")))
    rows = got.join(labels, "doc_id").where("held").collect()
    assert got.count() == docs.count() and len(rows) > 80
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.collect())
    none = toxicity.score_toxicity(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_small_languages_are_calibrated(spark, monkeypatch):
    docs, labels = labelled(spark)
    made, count = [], toxicity._label_counts
    monkeypatch.setattr(toxicity, "_label_counts", lambda *args: made.append(count(*args)) or made[-1])
    model = toxicity.fit(docs, labels, max_fit_rows=160)
    assert set(model["thresholds"]) == {"en", "de", "fr"} and all(0 < t < 1 for t in model["thresholds"].values())
    learnable = labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert learnable - 160 <= made[0].agg(F.sum("n")).first()[0] < learnable


def test_few_labels_pull_a_threshold_to_the_overall_cut(spark, monkeypatch):
    docs, labels = labelled(spark)
    counts = [("en", 0, 0, 500), ("en", 64, 1, 500), ("de", 128, 0, 2), ("de", 192, 1, 2), ("fr", 128, 0, 200), ("fr", 192, 1, 200), ("es", 0, 0, 9)]
    monkeypatch.setattr(toxicity, "_label_counts", lambda *args: spark.createDataFrame(counts, "lang string, bin long, toxic int, n long"))
    got = toxicity.fit(docs, labels, max_fit_rows=60)["thresholds"]
    assert got["es"] == 0.5 and 0.5 < got["de"] < got["fr"]


def test_pooling_ends_with_the_text():
    net = toxicity.ConvNet(1 << 10, 3)
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 1 << 10, (n, 2)) for n in (5, 0, 1, 2, 7)]
    edges = np.cumsum([0, *map(len, rows)])
    got = toxicity._score_rows(net.model(), np.concatenate(rows), edges, len(rows))
    assert got == pytest.approx(1 / (1 + np.exp(-net._forward(np.concatenate(rows), edges, None)["logit"])), abs=1e-5)


@pytest.mark.parametrize("sharp", [None, 2.0])
def test_convolution_gradients(sharp):
    """Back-propagation through pooling and filters against finite differences."""
    net, rng = toxicity.ConvNet(1 << 6, 3), np.random.default_rng(1)
    net.tables = net.tables.astype(np.float64) * 5
    net.bias[:] = 0.1  # away from the kink at 0, where an empty text is
    ids, edges = rng.integers(0, 1 << 6, (12, 2)), np.array([0, 5, 5, 6, 12])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.25, 0.5, 1, 0.25])

    def loss():
        z = net._forward(ids, edges, sharp)["logit"]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    grads, dx = net.gradients(ids, edges, y, weight, sharp)
    for name, values in {"out": net.out, "bias": net.bias, "shift": net.shift, **{f"f{w}": net.filters[w] for w in toxicity.WIDTHS}}.items():
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 7)]:
            was = values[at]
            values[at] = was + 2e-4
            high = loss()
            values[at] = was - 2e-4
            low = loss()
            values[at] = was
            assert (high - low) / 4e-4 == pytest.approx(grads[name][at], abs=2e-3)
    summed = np.zeros_like(net.tables[0])
    np.add.at(summed, ids[:, 0], dx[:, : toxicity.HALF])
    for b in np.unique(ids[:, 0])[:5]:
        net.tables[0][b, 1] += 2e-4
        high = loss()
        net.tables[0][b, 1] -= 4e-4
        low = loss()
        net.tables[0][b, 1] += 2e-4
        assert (high - low) / 4e-4 == pytest.approx(summed[b, 1], abs=2e-3)


def test_random_start_learns_toxicity(spark):
    """The query's held-out figures: nothing but training tells toxic texts from clean ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = queries.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    ranks = got["score"].rank()
    bad = got["toxic"] == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    print("held out:", len(got), "auc", auc, "recall", got["predicted"][bad].mean(), "flagged", got["flagged"][bad].mean(), "false", got["predicted"][~bad].mean())
    assert auc > 0.95 and got["predicted"][bad].mean() > 0.75 and got["predicted"][~bad].mean() < 0.01


def test_language(spark):
    docs, _ = labelled(spark)
    got = language.identify(docs, language.fit(docs, steps=120)).join(docs.select("doc_id", "lang", "text"), "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["held"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert {(r["doc_id"], r["score"]) for r in got if r["lang_pred"] == "und"} == {(700, 0.0), (701, 0.0), (702, 0.0)}
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), nothing).count() == 0


def test_recurrent_gradients():
    """Back-propagation through time against finite differences."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (6, 3))
    table, u = rng.normal(0, 0.5, (256, 24)).astype(np.float32), rng.normal(0, 0.5, (8, 24)).astype(np.float32)
    weight = rng.normal(size=(6, 3, 8)).astype(np.float32)
    kept: list = []
    language._direction(x, table, u, kept)
    dt, du = language._back(x, weight, u, kept)
    loss = lambda t, v: float((language._direction(x, t.astype(np.float32), v.astype(np.float32)) * weight).sum())
    for m, grad in ((u, du), (table, dt)):
        for i, j in ((0, 0), (3, 9), (7, 20)):
            i = int(x[0, 0]) if m is table else i
            step = np.zeros_like(m)
            step[i, j] = 1e-2
            near = (loss(table + step, u) - loss(table - step, u)) / 2e-2 if m is table else (loss(table, u + step) - loss(table, u - step)) / 2e-2
            assert near == pytest.approx(grad[i, j], abs=2e-2)


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.score_quality(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 and 0 < r["host_posterior"] < 1 and 0 < r["path_posterior"] < 1 for r in got.collect())
    assert quality.score_quality(docs, labels.limit(0)).where("keep").count() in (0, docs.count())
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    """A site of one document is the global prior to it, as it is no evidence for itself; a large bad site stays bad."""
    good, bad = "plain words go on and on like this", "BAD!! WORDS!! GO!! ON!! AND!! ON!!"
    rows = [(i, good, "en", "good") for i in range(200)] + [(200 + i, bad, "en", "bad") for i in range(200)] + [(400, bad, "en", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).where("doc_id in (0, 200, 400)").collect()}
    assert got[200]["host_posterior"] < 0.1 < 0.4 < got[400]["host_posterior"] < 0.6 < 0.9 < got[0]["host_posterior"]


def test_posteriors_match_a_plain_version(spark):
    """Sums without the document itself, moments about the level above, in plain Python."""
    docs, labels = labelled(spark)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    rows = [r for r in docs.collect()]
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in rows}
    p = {r["doc_id"]: got[r["doc_id"]]["doc_score"] for r in rows if r["text"]}
    mean = np.mean(list(p.values()))
    groups = lambda key: {k: np.array([p[i] for i in p if key(site[i]) == k]) for k in {key(site[i]) for i in p}}
    hosts, paths = groups(lambda s: s[0]), groups(lambda s: s)

    def weight(parts, above, n_above, priors):
        n, k = sum(map(len, parts.values())), len(parts)
        inside = sum(((v - v.mean()) ** 2).sum() for v in parts.values()) / (n - k)
        between = sum(len(v) * (v.mean() - above(s)) ** 2 for s, v in parts.items()) / (k - priors)
        outside = max(0, (between - inside) / ((n - sum(len(v) ** 2 / n_above(s) for s, v in parts.items())) / (k - priors)))
        return min(1e6, max(1, inside / outside if outside else 1e6))

    w1 = weight(hosts, lambda s: mean, lambda s: len(p), 1)
    w2 = weight(paths, lambda s: hosts[s[0]].mean(), lambda s: len(hosts[s[0]]), len(hosts))
    for i, s in site.items():
        own, one = p.get(i, 0), int(i in p)
        sums = lambda parts, key: (parts[key].sum(), len(parts[key])) if key in parts else (0, 0)
        (a, n), (b, m) = sums(hosts, s[0]), sums(paths, s)
        m1 = (max(a - own, 0) + w1 * mean) / (n - one + w1)
        m2 = (max(b - own, 0) + w2 * m1) / (m - one + w2)
        assert (got[i]["host_posterior"], got[i]["path_posterior"]) == pytest.approx((m1, m2), rel=1e-6)
        z = np.log(p.get(i, mean) / (1 - p.get(i, mean))) + np.clip(np.log(m2 / (1 - m2)) - np.log(mean / (1 - mean)), -1, 1)
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_held_out(spark):
    """Labels that were not learned from."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    held = toxicity.held_out(F.col("doc_id"))
    got = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    right = (got["keep"] == (got["quality"] == 1)).mean()
    print("held out:", len(got), "right", right)
    assert len(got) > 500 and right > 0.98

"""Quality classification by hierarchical empirical Bayes.

A logistic document classifier over shape features (numpy, fitted on a bounded
sample of labelled rows) gives each document a chance of being good. Sites are
hosts (``source``) and paths below them (``source`` and ``lang``). Their posteriors
shrink sparse sites toward what lies above:

    global prior   m0 = mean chance over all documents
    host           m1 = (sum over host  + w_host * m0) / (n_host + w_host)
    path           m2 = (sum over path  + w_path * m1) / (n_path + w_path)

A document's own chance is left out of the sums and counts of its host and path, so that it is
no evidence for itself. The weights are fitted from the data by moments, between hosts about the
global mean and between paths about the mean of their host: with little difference between
sites they are large and sites say little, with a lot they are small. Sums come
from grouped aggregation, which Spark combines before the shuffle, so a host with
a third of all rows is no hot key.

The final log odds are the document's own, moved by the site's log odds against
the global prior, by at most ``site_pull``: a site tips documents that are in
doubt by themselves and cannot throw out clear ones.

Shape features are shares that do not depend on the length of a text, over the
whole text.

Defined results: a null text counts as empty; an empty text has the global
chance as its own; a null source or lang is a site of its own; rows that repeat a doc_id, or have none, are judged each by its own text and site; where labels are
missing or all of one kind every document has that label's smoothed share as its
chance; columns of documents besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import bounded_sample, cut
from quillspark.llm._text import LOWER, NOT_SPACE, gram_hashes, slices, word_hashes, words

FEATURES = ("upper", "symbol", "digit", "non_ascii", "word_length", "repeated_words", "repeated_grams", "line_length", "odd_ends", "loose_symbols", "log_words")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*b".,;:?'\")-"]] = True
_PLAIN |= ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) | (np.arange(256) >= 128) | ((np.arange(256) >= 48) & (np.arange(256) <= 57))


def text_features(column: pa.Array) -> np.ndarray:
    """The shape of each text, one row of ``FEATURES`` each; an empty text is all zero."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, last, data, offsets in slices(column):
        if not len(data):
            continue
        rows = last - first
        count = np.diff(offsets)
        per = np.maximum(count, 1)
        add = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
        letters = np.maximum(add((((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 128)), 1)
        block = out[first:last]
        block[:, 0] = add((data >= 65) & (data <= 90)) / letters
        block[:, 1] = add(_SYMBOL[data]) / per
        block[:, 2] = add((data >= 48) & (data <= 57)) / per
        block[:, 3] = add(data >= 128) / per
        starts, ends, row = words(LOWER[data], offsets, NOT_SPACE)
        n = np.bincount(row, minlength=rows)
        many = np.maximum(n, 1)
        block[:, 4] = np.bincount(row, weights=np.minimum(ends - starts, 40), minlength=rows) / many / 10
        block[:, 7] = np.log1p(count / (1 + add(data == 10))) / 10
        block[:, 8] = np.bincount(row, weights=~_PLAIN[data[ends - 1]], minlength=rows) / many
        block[:, 9] = np.bincount(row, weights=(ends - starts == 1) & _SYMBOL[data[starts]], minlength=rows) / many
        block[:, 10] = np.log1p(n) / 10
        hashes = word_hashes(LOWER[data], starts, ends)
        edges = np.searchsorted(row, np.arange(rows + 1))
        for i in range(rows):
            own = hashes[edges[i] : edges[i + 1]]
            if len(own):
                block[i, 5] = 1 - len(np.unique(own)) / len(own)
                grams = gram_hashes(own, 4)
                block[i, 6] = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0
    return out


def with_features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_bytes, and x: the features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "x"])

    kinds = dict(documents.dtypes)
    return documents.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]))


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, steps: int = 50) -> dict:
    """Ridge logistic regression on standardised features by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.zeros(x.shape[1]), "b": float(np.log(share / (1 - share)))}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge * len(y))
    pull[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1])}


def _chance(model: dict):
    """The model as a column expression over ``x``."""
    w = model["w"] / model["scale"]
    b = model["b"] - float((w * model["mean"]).sum())
    z = F.lit(b)
    for i, c in enumerate(w):
        z = z + F.get("x", F.lit(i)) * float(c)
    return z


def _weight(sums: DataFrame, above: Column, groups: int) -> float:
    """How many documents the prior ``above`` counts as: within-site over between-site variance, by moments over all sites below ``groups`` priors."""
    away = F.col("s") / F.col("n") - above
    row = sums.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n") / F.col("all_n")).alias("nn"),
        F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") * away * away).alias("between"),
    ).first()
    if not row["n"] or row["k"] <= groups or row["n"] <= row["k"]:
        return 1e6
    inside = row["within"] / (row["n"] - row["k"])
    free = row["k"] - groups
    outside = max(0.0, (row["between"] / free - inside) / max((row["n"] - row["nn"]) / free, 1e-9))
    return float(min(1e6, max(1.0, inside / outside if outside > 0 else 1e6)))


def score_quality(documents: DataFrame, labels: DataFrame, *, max_fit_rows: int = 20_000, site_pull: float = 1.0, reject_below: float = 0.5) -> DataFrame:
    """doc_id, doc_score, host_posterior, path_posterior, score (0 to 1, higher: better), keep.

    ``max_fit_rows`` bounds the labelled rows that the document classifier is
    fitted on; they are the rows below a hash cut. All else covers all rows.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    featured = cut(with_features(documents, ["doc_id", "source", "lang"]))
    sample = bounded_sample(featured.join(known, "doc_id").select("doc_id", "x", "quality"), max_fit_rows).toPandas().sort_values("doc_id", ignore_index=True)
    x = np.array(sample["x"].tolist()).reshape(len(sample), len(FEATURES))
    model = fit_logistic(x, sample["quality"].to_numpy(np.float64))
    logit = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), _chance(model)))
    empty = F.forall("x", lambda v: v == 0)
    scored = featured.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), F.when(~empty, logit).alias("z"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    # sites of empty texts alone are among them, with n = 0
    paths = cut(scored.groupBy("host", "path").agg(F.count("p").alias("n"), add(F.col("p")).alias("s"), add(F.col("p") * F.col("p")).alias("s2")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total["s"] / total["n"]) if total["n"] else float(1 / (1 + np.exp(-model["b"])))
    mean = min(1 - 1e-6, max(1e-6, mean))
    named = hosts.select(F.col("host").alias("h"), F.col("n").alias("all_n"), F.col("s").alias("all_s"))
    sites = cut(paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    w_host = _weight(hosts.where("n > 0").withColumn("all_n", F.lit(total["n"])), F.lit(mean), 1)
    w_path = _weight(sites.where("n > 0"), F.col("all_s") / F.col("all_n"), hosts.where("n > 0").count())
    below = sites.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "n", "s", "all_n", "all_s")
    joined = scored.join(below, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    # without the document's own chance; a text that is empty has none in the sums
    own, one = F.coalesce("p", F.lit(0.0)), F.col("p").isNotNull().cast("int")
    posterior = lambda s, n, w, prior: (F.greatest(F.coalesce(F.col(s), F.lit(0.0)) - own, F.lit(0.0)) + w * prior) / (F.coalesce(F.col(n), F.lit(0)) - one + w)
    joined = joined.withColumn("m1", posterior("all_s", "all_n", w_host, F.lit(mean))).withColumn("m2", posterior("s", "n", w_path, F.col("m1")))
    log_odds = lambda c: F.log(c / (1 - c))
    near = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    pull = F.greatest(F.lit(-site_pull), F.least(F.lit(site_pull), log_odds(near(F.col("m2"))) - log_odds(F.lit(mean))))
    joined = joined.withColumn("z", F.coalesce("z", log_odds(F.lit(mean))))
    score = 1 / (1 + F.exp(-(F.col("z") + pull)))
    return joined.select(
        "doc_id", (1 / (1 + F.exp(-F.col("z")))).alias("doc_score"), F.col("m1").alias("host_posterior"), F.col("m2").alias("path_posterior"),
        score.alias("score"), (score >= reject_below).alias("keep"),
    )

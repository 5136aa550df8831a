"""Toxicity by a convolutional text classifier.

Words have hashed embeddings: one half by the whole word, the other by its first
``STEM`` bytes, so that inflected and joined forms share a half, and a short word
looks like another only where two independent hashes collide. Filters of several
widths run over the words, their outputs are max-pooled over the whole text,
and a logistic layer scores what is left. The network starts from random numbers and is trained in numpy, by
back-propagation, on a bounded sample of labelled rows
(``max_fit_rows``, in equal parts of both labels, those below a hash cut, and ``max_fit_bytes`` of their texts).
In the first epochs the pooling is softened (a log mean of exponentials, which passes a gradient to every
place), then it becomes the maximum (``PHASES``). Words are dropped at random while it learns, and embeddings decay.

A part of the sample (``calibration`` of it) is kept from training. On it and on all
labelled rows outside the sample and the held-out fifth the score is
calibrated so that 0.5 is the cut for all texts, and a threshold is set for each
language: Spark scores them and counts labels by language and bin of the logit. A
language's own cut is drawn toward the overall one, the more so the fewer labels it has (``PULL``).
Language is no input of the score: its threshold only makes the ``flagged`` column.

For scoring, all filters are one matrix, so that each word is multiplied once, and
convolution is addition of shifted columns.

Defined results: a null or empty text is scored as padding alone; words are runs
of ASCII letters, digits and non-ASCII characters, in lower case; with no labels
or one kind of label the score is that label's smoothed share; a language without
both labels among the rows not trained on has 0.5; labels that disagree on a doc_id count as their largest;
rows that repeat a doc_id, or have none, are scored each by its own text (a repeated id is learned from once);
columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import bounded_sample, cut, sampled_texts
from quillspark.llm._text import ALNUM, LOWER, slices, word_hashes, words

WIDTHS = (1, 2, 3)
FILTERS = 8
HALF = 4
STEM = 8
SLICE = 1 << 18
BIN = 1 / 64  # of the logit
PHASES = ((1.0, 4), (4.0, 2), (None, 3))  # sharpness of the pooling, epochs
PULL = 20  # labels of a language's rarer kind at which its own cut and the overall one weigh the same


def tokens(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, buckets of each word (word x 2), first word of each row and the end)."""
    for first, last, data, offsets in slices(column, SLICE):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, ALNUM)
        stems = word_hashes(data, starts, np.minimum(ends, starts + STEM)) >> np.uint64(32)
        both = np.column_stack([word_hashes(data, starts, ends), stems]) & np.uint64(buckets - 1)
        both = both.astype(np.int64)
        yield first, last - first, both, np.searchsorted(row, np.arange(last - first + 1))


class ConvNet:
    """Hashed embeddings, filters of several widths, max pooling, a logistic layer."""

    def __init__(self, buckets: int, seed: int):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.1, (2, buckets, HALF)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0

    def _forward(self, ids: np.ndarray, edges: np.ndarray, sharp: float | None) -> dict:
        """Everything back-propagation needs, for texts of words ``ids`` between ``edges``; ``sharp``: of the softened maximum, None: the maximum."""
        n = np.diff(edges)
        row, full = np.repeat(np.arange(len(n)), n), np.flatnonzero(n)
        x = np.concatenate([self.tables[0][ids[:, 0]], self.tables[1][ids[:, 1]]], axis=1)
        same = {k: (row[k:] == row[:-k])[:, None] for k in range(1, max(WIDTHS))}
        conv = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for j, w in enumerate(WIDTHS):
            own = conv[:, j * FILTERS : (j + 1) * FILTERS]
            own[:] = x @ self.filters[w][0]
            for k in range(1, w):
                own[:-k] += (x[k:] @ self.filters[w][k]) * same[k]
        pooled = np.zeros((len(n), conv.shape[1]), np.float32)
        shares = np.zeros_like(conv)  # of a pooled value's gradient that each place gets
        if len(full):
            pooled[full] = np.maximum.reduceat(conv, edges[full])
            if sharp is None:
                at = np.minimum.reduceat(np.where(conv == pooled[row], np.arange(len(x))[:, None], len(x)), edges[full])
                shares[at, np.arange(conv.shape[1])] = 1
            else:
                e = np.exp(sharp * (conv - pooled[row]))
                total = np.ones_like(pooled)
                total[full] = np.add.reduceat(e, edges[full])
                shares = e / total[row]
                pooled += np.log(total / np.maximum(n, 1)[:, None]) / np.float32(sharp)
        ahead = pooled + self.bias
        hidden = np.maximum(ahead, 0)
        return {"row": row, "x": x, "same": same, "shares": shares, "live": ahead > 0, "hidden": hidden, "logit": hidden @ self.out + self.shift[0]}

    def gradients(self, ids: np.ndarray, edges: np.ndarray, y: np.ndarray, weight: np.ndarray, sharp: float | None) -> tuple[dict, np.ndarray]:
        """Of the weighted cross entropy: by the dense parameters' names, and by each word's embedding."""
        made = self._forward(ids, edges, sharp)
        g = ((1 / (1 + np.exp(-np.clip(made["logit"], -30, 30))) - y) * weight).astype(np.float32)
        d = g[:, None] * self.out * made["live"]
        places, x, same = made["shares"] * d[made["row"]], made["x"], made["same"]
        grads = {"out": made["hidden"].T @ g, "bias": d.sum(axis=0), "shift": np.array([g.sum()], np.float32)}
        dx = np.zeros_like(x)
        for j, w in enumerate(WIDTHS):
            own = places[:, j * FILTERS : (j + 1) * FILTERS]
            df = np.zeros_like(self.filters[w])
            df[0] = x.T @ own
            dx += own @ self.filters[w][0].T
            for k in range(1, w):
                part = own[:-k] * same[k]
                df[k] = x[k:].T @ part
                dx[k:] += part @ self.filters[w][k].T
            grads[f"f{w}"] = df
        return grads, dx

    def train(self, rows: list[np.ndarray], y: np.ndarray, *, phases: tuple, rate: float, seed: int, batch: int = 32, decay: float = 1e-4, forget: float = 1e-3, drop: float = 0.3) -> None:
        """Adam for the dense parameters, Adagrad for the embeddings of the words of a batch, which decay by ``forget``."""
        rng = np.random.default_rng(seed)
        dense = {"out": self.out, "bias": self.bias, "shift": self.shift, **{f"f{w}": self.filters[w] for w in WIDTHS}}
        m1, m2 = ({k: np.zeros_like(v) for k, v in dense.items()} for _ in range(2))
        held = np.zeros_like(self.tables)
        rarer = float(np.sqrt((y == 0).sum() / max(1, (y == 1).sum())))
        step = 0
        for sharp, epochs in phases:
            for _ in range(epochs):
                order = rng.permutation(len(rows))
                for at in range(0, len(rows), batch):
                    pick, step = order[at : at + batch], step + 1
                    texts = [rows[i][rng.random(len(rows[i])) >= drop] for i in pick]
                    ids = np.concatenate(texts)
                    grads, dx = self.gradients(ids, np.cumsum([0, *map(len, texts)]), y[pick], np.where(y[pick] == 1, rarer, 1) / len(pick), sharp)
                    for k, g in grads.items():
                        if k == "out" or k[0] == "f":
                            g = g + decay * dense[k]
                        m1[k] = 0.9 * m1[k] + 0.1 * g
                        m2[k] = 0.999 * m2[k] + 0.001 * g * g
                        dense[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
                    for half in range(2):
                        part = dx[:, half * HALF : (half + 1) * HALF]
                        live = np.abs(part).max(axis=1) > 1e-9
                        unique, where = np.unique(ids[live, half], return_inverse=True)
                        total = forget * self.tables[half][unique]
                        np.add.at(total, where, part[live])
                        held[half][unique] += total * total
                        self.tables[half][unique] -= 5 * rate * total / (np.sqrt(held[half][unique]) + 1e-4)

    def model(self) -> dict:
        """What scoring needs; all filters side by side, a block of columns for each width and place."""
        wide = np.concatenate([self.filters[w][k] for w in WIDTHS for k in range(w)], axis=1)
        return {"tables": self.tables, "filters": wide, "bias": self.bias, "out": self.out, "shift": float(self.shift[0]), "scale": self.scale, "offset": self.offset, "buckets": self.tables.shape[1]}


def _logit_rows(model: dict, ids: np.ndarray, edges: np.ndarray, rows: int) -> np.ndarray:
    """Logits of whole texts from their words, not calibrated."""
    pooled = np.tile(model["bias"], (rows, 1))
    if len(ids):
        wide = np.concatenate([model["tables"][0][ids[:, 0]], model["tables"][1][ids[:, 1]]], axis=1) @ model["filters"]
        full = np.flatnonzero(np.diff(edges))
        starts, ends = edges[full], edges[full + 1]
        column = 0
        for j, w in enumerate(WIDTHS):
            conv = wide[:, column : column + FILTERS].copy()
            for k in range(1, w):
                block = wide[:, column + k * FILTERS : column + (k + 1) * FILTERS]
                crosses = np.zeros(len(ids), dtype=bool)
                for back in range(1, k + 1):
                    last = ends - back
                    crosses[last[last >= starts]] = True  # the kth word behind is in the next text: padding
                add = block[k:].copy()
                add[crosses[: len(add)]] = 0
                conv[: len(add)] += add
            column += w * FILTERS
            pooled[full, j * FILTERS : (j + 1) * FILTERS] += np.maximum.reduceat(conv, starts, axis=0)
    return np.maximum(pooled, 0) @ model["out"] + model["shift"]


def _score_rows(model: dict, ids: np.ndarray, edges: np.ndarray, rows: int) -> np.ndarray:
    """Scores of whole texts from their words."""
    return 1 / (1 + np.exp(-np.clip(model["scale"] * _logit_rows(model, ids, edges, rows) + model["offset"], -30, 30)))


def held_out(doc_id: Column) -> Column:
    """The fixed fifth of documents that no model here may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, *, max_fit_rows: int = 4000, max_fit_bytes: int = 1 << 26, buckets: int = 1 << 18, calibration: float = 0.25, phases: tuple = PHASES, seed: int = 7) -> dict:
    """Train on at most ``max_fit_rows`` labelled rows outside the held-out fifth; the model as arrays of fixed size, with thresholds by language."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    halves = [bounded_sample(known.where(F.col("toxic") == label), max_fit_rows // 2) for label in (0, 1)]
    got = sampled_texts(documents.select("doc_id", "text"), halves[0].unionByName(halves[1]).select("doc_id", "toxic"), max_fit_bytes, "toxic")
    net = ConvNet(buckets, seed)
    if not len(got) or got["toxic"].nunique() < 2:
        p = ((share["p"] or 0) * share["n"] + 1) / (share["n"] + 2)
        net.out[:], net.shift[0] = 0, float(np.log(p / (1 - p)))
        return net.model() | {"thresholds": {}}
    rows = [ids[a:b] for _, n, ids, e in tokens(pa.array(got["text"].fillna(""), pa.string()), buckets) for a, b in zip(e[:-1], e[1:], strict=True)]
    y = got["toxic"].to_numpy(np.float32)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        aside[rng.permutation(at)[: int(len(at) * calibration)]] = True
    learn = [rows[i] for i in np.flatnonzero(~aside)]
    net.train(learn, y[~aside], phases=phases, rate=0.01, seed=seed)
    trained = documents.sparkSession.createDataFrame([(int(i),) for i in got["doc_id"][~aside]], "doc_id long")
    counts = cut(_label_counts(documents, known.join(F.broadcast(trained), "doc_id", "left_anti"), net.model()))
    whole = counts.groupBy("bin", "toxic").agg(F.sum("n").alias("n")).toPandas()  # two rows a bin at most
    seen = [int(whole["n"][whole["toxic"] == label].sum()) for label in (0, 1)]
    # weights give the labels their share of all labelled rows again
    weights = [sum(seen) * p / max(n, 1) for p, n in zip((1 - share["p"], share["p"]), seen, strict=True)]
    middle = _binned_cut(whole, weights)
    net.offset = -middle

    def own(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        rarer = min(bins["n"][bins["toxic"] == label].sum() for label in (0, 1))
        z = (_binned_cut(bins, weights) - middle) * rarer / (rarer + PULL) if rarer else 0.0
        return pd.DataFrame({"lang": [key[0]], "threshold": [float(1 / (1 + np.exp(-z)))]})

    found = counts.where("lang is not null").groupBy("lang").applyInPandas(own, "lang string, threshold double").collect()
    return net.model() | {"thresholds": {r["lang"]: r["threshold"] for r in sorted(found)}}


def _label_counts(documents: DataFrame, known: DataFrame, model: dict) -> DataFrame:
    """(lang, bin, toxic, n): rows of ``known`` by their logit's bin. Texts are scored where they are; only numbers are joined."""
    scored = _scored(documents.where(~held_out(F.col("doc_id"))), model, lambda own, *words: np.clip(_logit_rows(own, *words), -30, 30))
    return scored.join(known.select("doc_id", "toxic"), "doc_id").groupBy("lang", F.floor(F.col("score") / BIN).alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n"))


def _binned_cut(bins: pd.DataFrame, weights: list[float]) -> float:
    truth = bins["toxic"].to_numpy()
    return _best_cut((bins["bin"].to_numpy() + 0.5) * BIN, truth, bins["n"].to_numpy() * np.array(weights)[truth])


def _best_cut(logit: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The logit that splits the labels with least weighted error, in the middle of the gap it lies in."""
    if not len(logit) or truth.min() == truth.max():
        return 0.0
    order = np.argsort(logit, kind="stable")
    z, t, w = logit[order], truth[order], weight[order]
    wrong = np.concatenate(([0], np.cumsum(w * (t == 1)))) + (np.sum(w * (t == 0)) - np.concatenate(([0], np.cumsum(w * (t == 0)))))
    wrong[1:-1][z[1:] == z[:-1]] = np.inf  # no cut between equal scores
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    i = int(best[len(best) // 2])
    low, high = (z[i - 1] if i else z[0] - 1), (z[i] if i < len(z) else z[-1] + 1)
    return float((low + high) / 2)


def _scored(documents: DataFrame, model: dict, value: Callable[[dict, np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """doc_id, lang and the ``value`` of each text's words as score."""
    shared = documents.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "thresholds"})  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, rows, ids, edges in tokens(batch.column("text"), own["buckets"]):
                scores = value(own, ids, edges, rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), batch.column("lang").slice(first, rows), pa.array(scores.astype(np.float64))], names=["doc_id", "lang", "score"])

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, lang string, score double")


def score_toxicity(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), threshold of the language, flagged (score >= that)."""
    scored = _scored(documents, model, _score_rows)
    pairs = [F.lit(x) for kv in model["thresholds"].items() for x in kv]
    threshold = F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None).cast("double"), F.lit(0.5))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))

"""Language identification by a bidirectional gated recurrent network over bytes.

Each text is cut into blocks of ``BLOCK`` bytes, all of them, and both directions
run over each block; every position is labelled from its two states, and a text's
probabilities are the mean over its positions. The network is trained in numpy
by back-propagation through time, on all blocks of a bounded sample of labelled rows:
each language gets an equal part of ``max_fit_rows``, those below its own hash cut, and
all of them together ``max_fit_bytes`` of text. States start anew in each block.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is
every text where no language was learned; ties go to the language that sorts
first; rows that repeat a doc_id, or have none, are judged each by its own text (a repeated id is learned from once); columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import sampled_texts
from quillspark.llm._text import slices
from quillspark.llm.toxicity import held_out

BLOCK = 64
HIDDEN = 8
SLICE = 1 << 18


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (block x place), valid places of each block, row of each block); the last block of a text is padded."""
    sizes = np.diff(offsets)
    count = (sizes + BLOCK - 1) // BLOCK
    row = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + within * BLOCK
    valid = np.minimum(BLOCK, offsets[1:][row] - start)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    return padded[start[:, None] + np.arange(BLOCK)[None, :]], valid, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _direction(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (place x block x hidden) of one direction over x (place x block)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape, HIDDEN), np.float32)
    for t in range(len(x)):
        a, b = table[x[t]], h @ u
        gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        own = b[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * own)
        if keep is not None:
            keep.append((h, z, r, n, own))
        h = n + z * (h - n)
        out[t] = h
    return out


def _back(x: np.ndarray, dout: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of ``u``, back through time."""
    du, dx, dh = np.zeros_like(u), np.empty((*x.shape, 3 * HIDDEN), np.float32), 0
    for t in range(len(x) - 1, -1, -1):
        before, z, r, n, own = kept[t]
        d = dout[t] + dh
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * own * r * (1 - r)
        db = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        du += before.T @ db
        dh = d * z + db @ u.T
    flat = x.ravel()
    wide = dx.reshape(-1, 3 * HIDDEN)
    return np.stack([np.bincount(flat, weights=wide[:, c], minlength=256) for c in range(3 * HIDDEN)], axis=1), du


def position_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """(place x block x language) for x (place x block)."""
    forward = _direction(x, model["tf"], model["uf"])
    backward = _direction(x[::-1], model["tb"], model["ub"])[::-1]
    logits = forward @ model["v"][:HIDDEN] + backward @ model["v"][HIDDEN:] + model["c"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def train(x: np.ndarray, valid: np.ndarray, y: np.ndarray, languages: int, *, steps: int, batch: int, rate: float, seed: int) -> dict:
    """Adam over cross entropy at every valid position of x (block x place)."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    model = {"tf": small(256, 3 * HIDDEN), "uf": small(HIDDEN, 3 * HIDDEN), "tb": small(256, 3 * HIDDEN), "ub": small(HIDDEN, 3 * HIDDEN), "v": small(2 * HIDDEN, languages), "c": np.zeros(languages, np.float32)}
    m1 = {k: np.zeros_like(v) for k, v in model.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(x))])
        pick, order = order[:batch], order[batch:]
        own = np.ascontiguousarray(x[pick].T)
        there = (np.arange(BLOCK)[:, None] < valid[pick][None, :]).astype(np.float32)
        kf: list = []
        kb: list = []
        hf = _direction(own, model["tf"], model["uf"], kf)
        hb = _direction(own[::-1], model["tb"], model["ub"], kb)
        states = np.concatenate([hf, hb[::-1]], axis=2)
        logits = states @ model["v"] + model["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(pick)), y[pick]] -= 1
        d = p * (there / there.sum())[:, :, None]
        grads = {"v": np.einsum("tbh,tbl->hl", states, d), "c": d.sum(axis=(0, 1))}
        ds = d @ model["v"].T
        grads["tf"], grads["uf"] = _back(own, ds[:, :, :HIDDEN], model["uf"], kf)
        grads["tb"], grads["ub"] = _back(own[::-1], np.ascontiguousarray(ds[::-1, :, HIDDEN:]), model["ub"], kb)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = (g * min(1.0, 1.0 / (norm + 1e-9))).astype(np.float32)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            model[k] = (model[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(documents: DataFrame, *, max_fit_rows: int = 2000, max_fit_bytes: int = 1 << 23, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 5) -> dict:
    """Learn from text and non-null lang of documents outside the held-out fifth, in ``steps`` batches at least and so many that every block of the sample is used."""
    known = documents.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return {"languages": []}
    each = max(1, max_fit_rows // len(counts))
    cuts = [x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(2**63 - 1, -(2**63) + 2**64 * each // n)))]
    sample = known.where(F.xxhash64("doc_id", F.lit(17)) <= F.element_at(F.create_map(*cuts), F.col("lang")))
    got = sampled_texts(known, sample.select("doc_id").distinct(), max_fit_bytes, "lang")
    languages = sorted(got["lang"].unique())
    if not languages:
        return {"languages": []}
    xs, vs, ys = [], [], []
    label = np.array([languages.index(x) for x in got["lang"]])
    for first, _, data, offsets in slices(pa.array(got["text"], pa.string())):
        x, valid, row = blocks(data, offsets)
        xs.append(x)
        vs.append(valid)
        ys.append(label[first + row])
    x, valid, y = (np.concatenate(v) for v in (xs, vs, ys))
    return train(x, valid, y, len(languages), steps=max(steps, -(-len(x) // batch)), batch=batch, rate=rate, seed=seed) | {"languages": languages}


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score: the language of highest mean probability over all positions of the text."""
    languages = model["languages"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text"), SLICE):
                x, valid, row = blocks(data, offsets)
                total = np.zeros((last - first, len(languages)))
                for at in range(0, len(x), 8192):
                    part = slice(at, at + 8192)
                    p = position_probabilities(own, np.ascontiguousarray(x[part].T))
                    p *= (np.arange(BLOCK)[:, None] < valid[part][None, :])[:, :, None]
                    np.add.at(total, row[part], p.sum(axis=0))
                total /= np.maximum(1, np.diff(offsets))[:, None]
                best = total.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("letters").slice(first, last - first), pa.array([languages[i] for i in best], pa.string()), pa.array(np.minimum(1.0, total[np.arange(len(best)), best]))],
                    names=["doc_id", "letters", "lang", "p"],
                )

    wanted = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not languages:
        return wanted.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    named = wanted.mapInArrow(run, "doc_id bigint, letters boolean, lang string, p double")
    return named.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))

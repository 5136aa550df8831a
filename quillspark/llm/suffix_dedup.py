"""Exact substring deduplication by suffix sorting with a difference cover.

A byte is removed if it lies in a ``length``-byte string that also starts in a
document with a smaller doc_id; strings are judged on the input.

All suffixes of a corpus need not be in one array: only those that agree in
``length`` bytes have to be neighbours. Each string of ``length`` bytes is dealt out by its
anchor, the least hash of its ``GRAM``-byte grams: equal strings have equal anchors, so
they meet in one partition, whatever surrounds them. A context is a run of neighbouring
starts with one anchor, together with the bytes that their strings need.

A text that equals a text of a smaller doc_id goes whole, and takes no part in the rest.

1. The anchors of all contexts are written with their doc_id (copies of a text once for each
   task) and grouped; those of one document only cannot start a repeat and go.
2. The contexts of the others are cut out of the texts and written.
3. They are dealt out by anchor, and each partition sorts the suffixes of its distinct contexts by a
   difference cover of period 3: the
   sampled places (1 and 2 modulo 3) are named by triples of symbols, which are
   themselves named by sorting (the recursion ends there, since only ``length``
   bytes count); places 0 modulo 3 are sorted by their first byte and the name
   behind it; both are merged by what they have in common with each other: one byte and a name,
   or two bytes and a name. Neighbours with equal prefixes are one class, and its smallest
   doc_id decides. An anchor whose contexts are all equal needs no sorting.
4. Covered starts come back as spans; each document is cut once.

An anchor of more than ``HOT`` contexts (a passage that a third of all documents share) is too
much for one partition. Its contexts go another way to the same
result: Spark groups them by their bytes, combined before the shuffle, groups the strings of
the distinct ones, and joins the smallest doc_id of each start back to the documents' places.

Memory is bounded by ``HOT`` and ``RUN``: partitions are walked in order of their anchors, texts in slices
of about 1 MB, and a run of one anchor (a long line of dashes) is cut into contexts of ``RUN`` starts.
Nothing is collected, and joins choose their strategy by sizes that Spark has measured.

Defined results: a null text is empty; matches never cross documents; a text shorter
than ``length`` keeps all; rows that repeat a doc_id do not remove each other, and each is cut by its own
spans; rows of null doc_id keep all and remove nothing; columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import cut, remove, written
from quillspark.llm._text import _BASE, SLICE_BYTES, mix, powers, seeds, slices

LENGTH = 50
GRAM = 20
HOT = 10_000
RUN = 1_024
SPANS = "array<struct<start:bigint,end:bigint>>"
_BYTE = seeds(256, 31)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverses = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        full = np.full(max(n, 256), _INVERSE)
        full[0] = 1
        _inverses = np.cumprod(full)
    return _inverses


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place that has them."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(len(data))[: len(data)])))
    return mix((sums[GRAM:] - sums[:-GRAM]) * _inverse_powers(n)[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if size < width else out


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, anchor) of each context of the texts between ``offsets``, which may reach beyond ``data``."""
    own = grams(data)
    width = LENGTH - GRAM + 1
    if len(own) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    least = _least(own, width)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    at = np.flatnonzero(np.arange(LENGTH, len(least) + LENGTH) <= offsets[row + 1])  # strings that do not cross texts
    if not len(at):
        return at, at, at, np.zeros(0, np.uint64)
    h = least[at]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1))))
    size = np.diff(np.append(first, len(at)))
    parts = -(-size // RUN)
    if parts.max() > 1:
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - within * RUN, RUN)
        first = np.repeat(first, parts) + within * RUN
    return row[at[first]], at[first], at[first] + size - 1, h[first]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of slices of a text column; a long text comes in several, which share the bytes that strings need."""
    for first, last, data, offsets in slices(column):
        for at in range(0, max(1, len(data) - LENGTH + 1), SLICE_BYTES):
            yield first, last, data[at : at + SLICE_BYTES + LENGTH - 1], offsets - at


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False)
        digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
        new = np.zeros(len(digests), dtype=bool)
        for i, x in enumerate(digests):
            if x not in seen:
                seen.add(x)
                new[i] = len(raw[i]) >= LENGTH
        del raw
        ids = batch.column("doc_id").filter(pa.array(new)).to_numpy(zero_copy_only=False)
        for first, _, data, offsets in _pieces(batch.column("text").filter(pa.array(new))):
            row, _, _, h = contexts(data, offsets)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[first + row])], names=["h", "doc_id"])


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts whose anchors are wanted. An anchor that one document of a slice wants is one that all of them want."""
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
        go = np.ones(batch.num_rows, dtype=bool)
        for i in np.flatnonzero(batch.column("copies").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
            go[i] = keys[i] not in batch.column("copies")[int(i)].as_py()
        rows = batch.filter(pa.array(go))
        ids, keys = ids[go], keys[go]
        for first, last, data, offsets in _pieces(rows.column("text")):
            row, low, high, h = contexts(data, offsets)
            h = h.view(np.int64)
            pick = np.flatnonzero(np.isin(h, _flat(rows.column("hashes").slice(first, last - first))))
            if not len(pick):
                continue
            row, low, high, h = row[pick], low[pick], high[pick], h[pick]
            hot = np.isin(h, _flat(rows.column("hot").slice(first, last - first)))
            size = high - low + LENGTH
            ends = np.cumsum(size)
            flat = data[np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(low, size)]
            context = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(hot), pa.array(ids[first + row]), pa.array(keys[first + row]), pa.array(low - offsets[row]), context], names=["h", "hot", "doc_id", "key", "low", "context"])


def _named(*keys: np.ndarray) -> np.ndarray:
    """Dense names in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_classes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class for each start: equal where the ``LENGTH`` bytes there are equal, in the suffixes' order.

    ``starts`` is ascending, and text goes on for ``LENGTH`` bytes behind each.
    """
    # sampled places: 1 and 2 modulo 3, those behind a start included
    deep = LENGTH - 2
    near = np.unique(np.concatenate([starts, starts + 1, starts + 2]))
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)])
    sample = near[near % 3 != 0]

    def symbols(at: np.ndarray, size: int) -> np.ndarray:
        """Big-endian numbers of up to 8 bytes."""
        out = np.zeros(len(at), np.uint64)
        for j in range(size):
            out = (out << np.uint64(8)) | padded[at + j].astype(np.uint64)
        return out

    third = deep // 3  # a triple of symbols of 16 bytes
    at = np.concatenate([sample, sample + third, sample + 2 * third])
    name = _named(symbols(at, 8), symbols(at + 8, third - 8)).reshape(3, -1)
    rank = np.zeros(int(near[-1]) + 1, dtype=np.int64)
    rank[sample] = _named(name[0], name[1], name[2]) + 1

    mod = starts % 3
    a, b = padded[starts].astype(np.int64), padded[starts + 1].astype(np.int64)
    y, z = padded[starts + deep].astype(np.int64), padded[starts + deep + 1].astype(np.int64)
    sampled, rest = np.flatnonzero(mod != 0), np.flatnonzero(mod == 0)
    own = _named(rank[starts[sampled]], y[sampled], z[sampled])
    left = _named(a[rest], rank[starts[rest] + 1], z[rest])

    # merge: a place 0 meets a place 1 as (byte, name, last byte), a place 2 as (two bytes, name)
    below = np.zeros(len(rest), np.int64)  # sampled classes below each class of the rest
    twin = np.full(len(rest), -1)
    for m in (1, 2):
        part = mod[sampled] == m
        s = sampled[part]
        if not len(s) or not len(rest):
            continue
        if m == 1:
            keys = [np.concatenate([f(rest), f(s)]) for f in (lambda i: a[i], lambda i: rank[starts[i] + 1], lambda i: z[i])]
        else:
            keys = [np.concatenate([f(rest), f(s)]) for f in (lambda i: a[i], lambda i: b[i], lambda i: rank[starts[i] + 2])]
        both = _named(*keys)
        mine, theirs = both[: len(rest)], both[len(rest) :]
        order = np.argsort(theirs, kind="stable")
        place = np.searchsorted(theirs[order], mine)
        met = (place < len(s)) & (theirs[order][np.minimum(place, len(s) - 1)] == mine)
        twin[met] = own[part][order][place[met]]
        reached = np.where(place > 0, own[part][order][np.maximum(place - 1, 0)] + 1, 0)
        below = np.maximum(below, reached)
    out = np.empty((len(starts), 2), dtype=np.int64)
    out[sampled, 0], out[sampled, 1] = own, -1
    out[rest, 0] = np.where(twin >= 0, twin, below)
    # a class of the rest without a twin stands right before the sampled class that follows it
    out[rest, 1] = np.where(twin >= 0, -1, left - left.max(initial=0) - 2)
    return _named(out[:, 0], out[:, 1])


def _least_of_starts(edges: np.ndarray, text: np.ndarray, count: np.ndarray, least: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each start of each distinct context; only contexts that share their anchor with others are sorted."""
    out = np.repeat(least, count)
    _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
    several = times[inverse] > 1
    if several.any():
        among = np.repeat(several, count)
        first = np.cumsum(count) - count
        starts = np.arange(len(out)) - np.repeat(first, count) + np.repeat(edges[:-1], count)
        group = suffix_classes(text, starts[among])
        smallest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, out[among])
        out[among] = smallest[group]
    return out


def _walked(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about so many rows; no anchor is in two of them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            h = batch.column("h").to_numpy()
            change = np.flatnonzero(h != held[-1].column("h")[-1].as_py())
            cut_at = int(change[0]) if len(change) else len(h)
            held.append(batch.slice(0, cut_at))
            if len(change):
                yield pa.Table.from_batches(held)
                held, n = [batch.slice(cut_at)], len(h) - cut_at
            continue
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans of a partition's contexts, in order of their anchors. All strings of an anchor are here."""
    for rows in _walked(batches):
        doc, low = rows["doc_id"].to_numpy(), rows["low"].to_numpy()
        coded = rows["context"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = coded.dictionary
        _, where, flat = texts.buffers()
        edges = np.frombuffer(where, np.int32)[: len(texts) + 1].astype(np.int64)
        count = np.diff(edges) - LENGTH + 1
        least, anchor = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
        np.minimum.at(least, code, doc)
        anchor[code] = rows["h"].to_numpy()
        smallest = _least_of_starts(edges, np.frombuffer(flat, np.uint8), count, least, anchor)
        first = np.cumsum(count) - count
        # a context can be covered only where its own document is not the first with one of its strings
        lowest = np.minimum.reduceat(smallest, first)
        some = np.flatnonzero(lowest[code] < doc)
        key = rows["key"].to_numpy()
        step = max(1, 2_000_000 // int(count.max()))
        for at in range(0, len(some), step):
            i = some[at : at + step]
            c, d, lo = code[i], doc[i], low[i]
            n = count[c]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            covered = smallest[np.repeat(first[c], n) + within] < np.repeat(d, n)
            new = covered.copy()
            new[1:] &= ~(covered[:-1] & (within[1:] > 0))
            end = covered.copy()
            end[:-1] &= ~(covered[1:] & (within[1:] > 0))
            s, e = np.flatnonzero(new), np.flatnonzero(end)
            place = np.repeat(lo, n) + within
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d, n)[s]), pa.array(np.repeat(key[i], n)[s]), pa.array(place[s]), pa.array(place[e] + LENGTH)], names=["doc_id", "key", "start", "end"])


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def whole_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, first) of texts of ``LENGTH`` bytes or more that equal a text of a smaller doc_id, ``first``: all of them goes."""
    known = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    known = known.where(F.col("n_bytes") >= LENGTH)
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return known.join(first, "digest").where(F.col("doc_id") > F.col("first")).select("doc_id", "key", "n_bytes", "first").distinct()


def _wanted(own: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, hashes, hot, copies): anchors of a document that other documents have too, the hot ones among them, and keys of its texts that are copies."""
    found, path = written(own.select("doc_id", "text").mapInArrow(_anchors, "h bigint, doc_id bigint"), "anchors")
    several = found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("h", (F.col("n") > HOT).alias("hot"))
    several = cut(several)
    known = cut(found.join(several, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hashes"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot")))
    remove(own.sparkSession, path)
    # a task writes the anchors of equal texts once, maybe under the doc_id of a copy: they are the first one's
    moved = known.join(copies.select("doc_id", "first").distinct(), "doc_id")
    moved = moved.select(F.col("first").alias("doc_id"), F.explode("hashes").alias("h"), "hot").select("doc_id", "h", F.array_contains("hot", F.col("h")).alias("is_hot"))
    moved = moved.groupBy("doc_id").agg(F.collect_set("h").alias("more"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("more_hot"))
    none = F.array().cast("array<bigint>")
    both = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)).alias(a)
    wanted = known.join(moved, "doc_id", "full").select("doc_id", both("hashes", "more"), both("hot", "more_hot"))
    return wanted.join(copies.groupBy("doc_id").agg(F.collect_set("key").alias("copies")), "doc_id", "left")


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Covered spans of the hot anchors' contexts, without a partition that holds all of an anchor."""
    distinct = cut(contexts.groupBy("context").agg(F.min("doc_id").alias("least")))
    strings = distinct.select("context", "least", F.posexplode(F.expr(f"transform(sequence(1, octet_length(context) - {LENGTH - 1}), i -> substring(context, i, {LENGTH}))")).alias("at", "string"))
    # written first: Spark can split a join of two tables where many contexts hold one string
    smallest = cut(strings.groupBy("string").agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("string", "m"))
    starts = strings.join(smallest, "string", "left").groupBy("context").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("m", "least").alias("m")))).alias("starts"))
    placed = contexts.join(cut(starts.select("context", F.col("starts.m").alias("m"))), "context")
    placed = placed.select("doc_id", "key", "low", F.expr("transform(m, x -> x < doc_id)").alias("c")).where("exists(c, x -> x)")
    edge = lambda beside: f"filter(sequence(0, size(c) - 1), i -> c[i] and not coalesce(get(c, i {beside}), false))"
    runs = placed.select("doc_id", "key", "low", F.explode(F.arrays_zip(F.expr(edge("- 1")).alias("a"), F.expr(edge("+ 1")).alias("b"))).alias("r"))
    return runs.select("doc_id", "key", (F.col("low") + F.col("r.a")).alias("start"), (F.col("low") + F.col("r.b") + LENGTH).alias("end"))


def shared_contexts(documents: DataFrame, copies: DataFrame) -> tuple[DataFrame, str]:
    """(h, hot, doc_id, key, low, context) of all contexts whose anchor is in several documents, as a table, and its path."""
    own = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    joined = own.join(_wanted(own, copies), "doc_id").select("doc_id", "text", "key", "hashes", "hot", "copies")
    return written(joined.mapInArrow(_cut_contexts, "h bigint, hot boolean, doc_id bigint, key bigint, low bigint, context binary"), "contexts")


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, key, spans): byte spans of a text, known by the xxhash64 ``key``, that repeat strings of documents with a smaller doc_id; they may overlap."""
    spark = documents.sparkSession
    copies = cut(whole_copies(documents))
    found, path = shared_contexts(documents, copies)
    # twice the usual partitions: each sorts its suffixes in memory
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = found.where("not hot").drop("hot").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_spans, "doc_id bigint, key bigint, start bigint, end bigint")
    hot = found.where("hot").drop("h", "hot")
    if not hot.isEmpty():
        spans = spans.unionByName(_hot_spans(hot))
    whole = copies.select("doc_id", "key", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    spans = cut(spans.unionByName(whole).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    remove(spark, path)
    return spans


def deduplicate(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): merged removed spans, and the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                gone = merged(spans)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
                removed.append([{"start": s, "end": e} for s, e in gone])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    spans = repeats(documents)
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("key")).join(spans, ["doc_id", "key"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id bigint, n_bytes bigint, spans {SPANS}, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

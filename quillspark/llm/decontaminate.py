"""Benchmark decontamination by winnowing.

Both texts become word sequences. Of the ``gram``-word hashes in each window of ``window`` consecutive
words the smallest (the last of equal ones) is kept as its fingerprint, with its place. A window that a document shares with an
item has the same fingerprint at the same place in it, so no shared span of that length is lost.

The distinct fingerprints of the benchmark are joined with those of the documents. Each hit is then extended: word by word to the left and
to the right of the fingerprint, as far as a window that holds it reaches. Where this makes up a window or more, its words are hit.
Overlapping extensions make up longer spans.

Items come in at the end. The join is over distinct contexts (a fingerprint and the words around it), whatever the number of items
that hold one; a context stands for a set of items, and each document gets the sets that it has met.

An item of fewer words is one window of its own length ``L``. Winnowing gives no
guarantee below ``window`` words, so for each such length that occurs every
``L``-word hash of the documents is a fingerprint, and its context is the item.

Fingerprints of documents are looked up in a Bloom filter of the benchmark's (16 bits or more for each
entry, ``bloom_bits`` at most) before they are shuffled: it only drops what the join
would drop. A fingerprint that many documents share is a skewed join that Spark can split.

Defined results: one row for each row of documents, whatever its doc_id (null and repeated ids included); a null or empty text has no words and is never hit; items
without words never occur; equal items are all reported, as items with one id
are one item; items of null id are left out; columns besides the named ones are
ignored; empty tables give empty (or clean) results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import cut
from quillspark.llm._text import ALNUM, LOWER, gram_hashes, mix, slices, word_hashes, words

ENTRY = "f bigint, at bigint, size bigint, words array<bigint>"
#: Stand for words beyond a text's ends, on either side: they equal nothing.
BEYOND_DOCUMENT, BEYOND_ITEM = np.uint64(1), np.uint64(2)


def _least(grams: np.ndarray, per: int) -> np.ndarray:
    """The smallest of each ``per`` consecutive hashes; for runs shorter than that none."""
    n = len(grams) - per + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    low, span = grams, 1
    while span < per:  # runs of ``span`` make up runs of up to twice as many
        step = min(span, per - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return low


def _sized(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, kept apart by size."""
    return gram_hashes(hashes, size) ^ np.uint64(0x9E3779B97F4A7C15 * size % 2**64)


def _places(grams: np.ndarray, kept: np.ndarray, windows: np.ndarray, per: int) -> np.ndarray:
    """Where the fingerprint of each of the ``windows`` lies: the last of the least of its ``per`` grams."""
    place = np.full(len(windows), -1)
    for d in range(per):
        place = np.where(grams[windows + d] == kept[windows], windows + d, place)
    return np.unique(place)


def _around(hashes: np.ndarray, row: np.ndarray, places: np.ndarray, before: int, width: int, beyond: np.uint64) -> np.ndarray:
    """The words (place x ``width``) from ``before`` words ahead of each place, within its row."""
    at = places[:, None] + np.arange(-before, width - before)
    inside = (at >= 0) & (at < len(hashes))
    at = np.clip(at, 0, max(0, len(hashes) - 1))
    return np.where(inside & (row[at] == row[places][:, None]), hashes[at], beyond)


class _Bloom:
    """Two bits for each entry."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, dtype=np.uint8)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for p in self._places(h):
            found &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _by_slice(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, row of each word from the first) of each slice of texts in a batch."""
    for first, last, data, offsets in slices(batch.column("text")):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, ALNUM)
        yield first, last, word_hashes(data, starts, ends), row


def _lists(rows: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def _fingerprints(hashes: np.ndarray, row: np.ndarray, window: int, gram: int, short: list[int], bloom: _Bloom | None, beyond: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places, fingerprints, words around them) of all windows within a row whose fingerprint the filter has; sizes below ``window`` are whole short items."""
    n, width, per = len(hashes), 2 * window - gram, window - gram + 1
    if n >= window:
        grams = gram_hashes(hashes, gram)
        kept = _least(grams, per)
        ok = row[: n - window + 1] == row[window - 1 :]
        if bloom is not None:
            new = np.concatenate(([True], kept[1:] != kept[:-1]))  # neighbours mostly share their fingerprint
            ok &= bloom.has(kept[new])[np.cumsum(new) - 1]
        places = _places(grams, kept, np.flatnonzero(ok), per)
        yield window, places, grams[places], _around(hashes, row, places, window - gram, width, beyond)
    for size in short:
        if n >= size:
            f = _sized(hashes, size)
            ok = row[: n - size + 1] == row[size - 1 :]
            places = np.flatnonzero(ok & bloom.has(f) if bloom is not None else ok)
            yield size, places, f[places], _around(hashes, row, places, 0, width, beyond)


def benchmark_contexts(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(f, size, context, items, set_id): each distinct fingerprint with the words around it, or short item as a whole, and the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for first, last, every, owner in _by_slice(batch):
                edges = np.searchsorted(owner, np.arange(last - first + 1))
                for row in range(first, last):
                    hashes = every[edges[row - first] : edges[row - first + 1]]
                    if not len(hashes) or not ids[row].is_valid:
                        continue
                    short = [len(hashes)] if len(hashes) < window else []
                    for size, places, f, around in _fingerprints(hashes, np.zeros(len(hashes), np.int64), window, gram, short, None, BEYOND_ITEM):
                        if size < window:  # what is behind a short item is no part of it
                            around[:, size:] = BEYOND_ITEM
                        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.full(len(places), size)), _lists(around), pa.array([ids[row].as_py()] * len(places), pa.string())], names=["f", "size", "context", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = items.mapInArrow(run, "f bigint, size bigint, context array<bigint>, item_id string").distinct()
    sets = found.groupBy("f", "size", "context").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return sets.withColumn("set_id", F.sha2(F.to_json("items").cast("binary"), 256))


def _extended(window: int, gram: int):
    """Joined hits to (row, start, end, set_id) of those that extend to a window or more."""
    left, width = window - gram, 2 * window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            document, item = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(m, width) for c in ("words", "context"))
            at, size = (batch.column(c).to_numpy() for c in ("at", "size"))
            same = document == item
            back = np.cumprod(same[:, :left][:, ::-1], axis=1).sum(axis=1)
            on = np.cumprod(same[:, left + gram :], axis=1).sum(axis=1)
            whole = same[:, left : left + gram].all(axis=1) & (back + gram + on >= window)
            short = np.cumprod(same, axis=1).sum(axis=1) >= size
            ok = np.where(size == window, whole, short)
            start = np.where(size == window, at - back, at)
            end = np.where(size == window, at + gram + on, at + size)
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (batch.column("row"), pa.array(start), pa.array(end), batch.column("set_id"))], names=["row", "start", "end", "set_id"])

    return run


def _filter_of(contexts: DataFrame, n: int, bloom_bits: int) -> _Bloom:
    """The filter of ``n`` contexts' fingerprints: bits are set in tasks, the driver gets its bytes."""
    bits = 1 << 13
    while bits < min(32 * n, bloom_bits):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Bloom(bits)
        for batch in batches:
            part.add(batch.column("f").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        used = np.flatnonzero(part.data)
        for at in range(0, len(used), 1 << 16):
            own = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(part.data[own].astype(np.int32))], names=["place", "bits"])

    bloom = _Bloom(bits)
    got = contexts.select("f").mapInArrow(fill, "place int, bits int").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()  # bloom_bits / 8 rows at most
    bloom.data[got["place"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    return bloom


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each row's ranges, in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("raw"):
            start, end = (spans.values.field(i).to_numpy() for i in range(2))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            last = np.append(first[1:], len(start)) - 1
            out.append([{"start": s, "end": e} for s, e in zip(start[first].tolist(), end[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], names=["row", "spans"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5, bloom_bits: int = 1 << 26) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (hit word ranges, end exclusive, merged and in order), items (ids with an occurrence, sorted as strings)."""
    contexts = cut(benchmark_contexts(benchmark, window, gram))
    size = F.col("size")
    known = contexts.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(size < window, size)).alias("short")).first()
    short = sorted(known["short"])  # at most window - 1 numbers
    bloom = _filter_of(contexts, known["n"], bloom_bits)
    bits, shared = len(bloom.data) * 8, documents.sparkSession.sparkContext.broadcast(bloom.data)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Bloom(bits)
        seen.data = shared.value
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            keys = batch.column("row").to_numpy()
            none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
            for first, last, hashes, row in _by_slice(batch):
                counts[first:last] = np.bincount(row, minlength=last - first)
                starts = np.cumsum(counts[first:last]) - counts[first:last]
                for size, places, f, around in _fingerprints(hashes, row, window, gram, short, seen, BEYOND_DOCUMENT):
                    m, own = len(places), row[places]
                    columns = (pa.array(keys[first:last][own]), none(m), none(m), pa.array(f.view(np.int64)), pa.array(places - starts[own]), pa.array(np.full(m, size)), _lists(around))
                    yield pa.RecordBatch.from_arrays(list(columns), names=names)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(counts), *(none(n) for _ in range(3)), none(n, pa.list_(pa.int64()))], names=names)

    names = ["row", "doc_id", "n_words", "f", "at", "size", "words"]
    # a row for each document (n_words is set) and one for each of its fingerprints that the filter has; numbers only, written once
    marked = cut(documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, f"row bigint, doc_id bigint, n_words bigint, {ENTRY}"))
    hits = marked.where("n_words is null").select("row", "f", "at", "size", "words")
    joined = hits.join(contexts.select("f", "size", "context", "set_id"), ["f", "size"]).select("row", "at", "size", "words", "context", "set_id")
    found = joined.mapInArrow(_extended(window, gram), "row bigint, start bigint, end bigint, set_id string")
    found = cut(found.groupBy("row", "set_id").agg(F.collect_set(F.struct("start", "end")).alias("raw")))
    spans = found.groupBy("row").agg(F.flatten(F.collect_list("raw")).alias("raw")).mapInArrow(_merged, "row bigint, spans array<struct<start:bigint,end:bigint>>")
    sets = contexts.groupBy("set_id").agg(F.first("items").alias("items"))
    met = found.select("row", "set_id").join(sets, "set_id").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = marked.where("n_words is not null").select("row", "doc_id", "n_words").join(spans, "row", "left").join(met, "row", "left")
    return every.select("doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def digest(marked: DataFrame) -> DataFrame:
    """The counts and the digest of a document's items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

"""MinHash near-duplicate grouping with SuperMinHash signatures.

SuperMinHash gives every set element a random permutation of the signature's
places; place ``p`` keeps the least ``rank + fraction`` over all elements. The
ranks of one element are correlated (each place gets another rank), which lowers
the variance against independent hashes, and an element stops early once no place
can still be lowered: after ``j`` ranks nothing is below ``j``.

1. Documents with equal shingle sets form a class; its smallest doc_id stands for it.
2. ``bands`` x ``rows`` signature places are banded. A pair at the threshold is
   missed by every band with a chance of about ``(1 - 0.75**rows) ** bands``
   (5e-6 by default).
3. In each bucket all members are linked to one hub, its smallest member, and
   the links are verified on full sets: that is linear in a bucket's size.
4. Union-find (``connected_components``) groups what is verified.
5. Where a bucket's members are still in several components, pairs across them
   may be links that went through no hub. These members' sets are joined on
   their rarest shingles: two sets with the needed overlap share one of their
   ``n - ceil(t n) + 1`` rarest, at places that leave room for the overlap. Only
   such pairs across components are made, and verified; nothing is capped.
6. Union-find once more over all verified links.

Links are ``100 * intersection >= 75 * union`` by default, in integers.

Defined results: a null or empty text, or one of white space, has an empty set and
is linked with nothing; a text of fewer than ``k`` words is one shingle; rows
that repeat a doc_id count once, of different texts the one of least xxhash64 counts; columns besides the named ones are
ignored; a row whose doc_id is null is left out.

Joins choose their strategy by sizes that Spark has measured; whole texts are shuffled once to those that a bucket
has beside others, and for each of their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import cut, remove, written
from quillspark.llm._text import LOWER, NOT_SPACE, gram_hashes, mix, seeds, slices, word_hashes, words
from quillspark.llm.components import connected_components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FRACTION = np.uint64(56)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of a text column."""
    for first, last, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, NOT_SPACE)
        hashes = word_hashes(data, starts, ends)
        edges = np.searchsorted(row, np.arange(last - first + 1))
        sets = []
        for i in range(last - first):
            own = hashes[edges[i] : edges[i + 1]]
            sets.append(np.unique(gram_hashes(own, min(k, len(own)))) if len(own) else own)
        yield first, sets


def superminhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures (set x place): rank in the upper byte, a random fraction below. Empty sets have no low values."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sizes.sum():
        return out.reshape(len(sets), places)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    steps = np.arange(1, places + 1, dtype=np.uint64) * _STEP
    order = None  # the permutations so far, made only for sets that need more than one rank
    for j in range(places):
        draw = mix(items + steps[j])
        pick = j + (((draw >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            at = pick
        else:
            base = rows * places
            at = order[base + pick]
            order[base + pick] = order[base + j]
            order[base + j] = at
        value = (np.uint64(j) << _FRACTION) | (mix(draw) >> np.uint64(8))
        np.minimum.at(out, owner * places + at, value)
        # a set goes on while one of its places may still get rank j + 1
        going = out.reshape(len(sets), places).max(axis=1) >= (np.uint64(j + 1) << _FRACTION)
        more = going[owner]
        if not more.any():
            break
        if j == 0:
            items, owner, first = items[more], owner[more], at[more]
            rows = np.arange(len(items))
            order = np.tile(np.arange(places, dtype=np.uint8), len(items))
            order[rows * places + first] = 0
            order[rows * places] = first
        elif not more.all():
            items, owner, rows = items[more], owner[more], rows[more]
    return out.reshape(len(sets), places)


def signatures(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, keys): set size, a 128-bit hash of the set, and a key for each band."""
    weight = seeds(rows, 21)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, sets in shingle_sets(batch.column("text"), k):
                signature = superminhash(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = mix((signature * weight).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                s1 = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
                s2 = np.array([int(mix(s ^ _STEP).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
                flat = pa.array(keys.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), batch.column("text_key").slice(first, len(sets)), pa.array(n), pa.array(s1), pa.array(s2), lists], names=["doc_id", "text_key", "n", "s1", "s2", "keys"])

    return _keyed(documents).mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. A text is sent once for each pair of its first side."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows, dtype=bool)
            # walk in short runs of rows, so that few sets are held at any time
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                mine = [s for _, sets in shingle_sets(part.column("text_a"), k) for s in sets]
                other = part.column("text_b").dictionary_encode()
                distinct = [s for _, sets in shingle_sets(other.dictionary, k) for s in sets]
                for i, (x, y) in enumerate(zip(mine, other.indices.to_pylist(), strict=True)):
                    y = distinct[y]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and len(x):
                        inter = len(np.intersect1d(x, y, assume_unique=True))
                        alike[at + i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(alike), batch.column("b").filter(alike)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _across(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of members (doc_id, n, root) of different roots that can be alike, found by their rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), k):
                sizes = np.array([len(s) for s in sets])
                at = np.repeat(np.arange(first, first + len(sets)), sizes)
                h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), batch.column("n").take(pa.array(at)), batch.column("root").take(pa.array(at)), pa.array(h.view(np.int64))], names=["doc_id", "n", "root", "h"])

    exploded = members.join(texts, "doc_id").select("doc_id", "n", "root", "text").mapInArrow(run, "doc_id bigint, n bigint, root bigint, h bigint")
    often = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = exploded.join(often, "h").groupBy("doc_id", "n", "root").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    # collect_list holds one document's own shingles
    rare = cut(ranked.select("doc_id", "n", "root", F.posexplode(F.slice("all", F.lit(1), prefix.cast("int"))).alias("pos", "e")).select("doc_id", "n", "root", "pos", F.col("e.h").alias("h"), F.col("e.df").alias("df")).where("df > 1").drop("df"))
    a, b = rare.alias("a"), rare.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent) - F.lit(1e-6))
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.root") != F.col("b.root")) & (room >= need)
    sized = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return a.join(b, on & sized).select(F.col("b.doc_id").alias("a"), F.col("a.doc_id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, *, k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    if bands * rows > 256:
        raise ValueError("a signature has at most 256 places")
    signed = cut(signatures(documents, k, bands, rows))
    several = signed.groupBy("doc_id").agg(F.min("text_key").alias("one"), F.max("text_key").alias("other")).where("one <> other").select("doc_id", "one")
    signed = signed.join(several, "doc_id", "left").where("one is null or one = text_key").drop("one")
    alike = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    # distinct rows first: above a join of copies, an aggregate would keep Spark from splitting a hot set
    placed = signed.select("doc_id", "n", "s1", "s2").distinct().join(alike, ["s1", "s2", "n"], "left")
    classes = cut(placed.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    reps = classes.where("doc_id = rep and n > 0").select("doc_id")
    banded = signed.join(reps, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text_key", "n", F.explode("keys").alias("key"))
    # only keys with a second member matter; their hub is the smallest one
    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "hub")
    members = cut(banded.join(hubs, "key").select("key", "hub", "doc_id", "text_key", "n"))
    found = members.select("doc_id", "text_key").distinct()
    texts, path = written(_keyed(documents).join(found, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text"), "members")
    spokes = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut(_verified(spokes, texts, k, percent))
    roots = cut(connected_components(links))
    placed = members.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_members = cut(placed.join(mixed, "key", "left_semi").select("doc_id", "n", "root").distinct())
    more = cut(_verified(_across(open_members, texts, k, percent), texts, k, percent))
    remove(documents.sparkSession, path)
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    return (
        classes.join(roots, F.col("rep") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
